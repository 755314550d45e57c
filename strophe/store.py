"""A dataset as a folder of Parquet tables with versions: a change writes a new version beside the old one, then points to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Dataset:
    """Tables under a base path (any path that Spark reads). Versions are numbered; the greatest complete one counts."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def tables(self) -> list[str]:
        return self._children(self.base)

    def version(self, table: str) -> int:
        """The greatest version whose write ended, 0 for none."""
        done = [n for n in self._children(f"{self.base}/{table}") if self._fs.exists(self._path(f"{self.base}/{table}/{n}/_SUCCESS"))]
        return max((int(n.removeprefix("v")) for n in done), default=0)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = version or self.version(table)
        if not version:
            raise KeyError(f"no table {table} in {self.base}")
        return self.spark.read.parquet(f"{self.base}/{table}/v{version:05d}")

    def write(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        version = self.version(table) + 1
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.base}/{table}/v{version:05d}")
        return version

    def change(self, table: str, f: Callable[[DataFrame], DataFrame]) -> int:
        """Copy on write: readers of the old version are not disturbed."""
        return self.write(table, f(self.read(table)))

    def clone(self, suffix: str) -> Dataset:
        other = Dataset(self.spark, self.base + suffix)
        for table in self.tables():
            if self.version(table):
                other.write(table, self.read(table))
        return other
