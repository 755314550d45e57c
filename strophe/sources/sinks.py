"""Outputs: flattened CSV and JSON, HTML and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_zero(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit("")) == ""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) <= 0
    return F.coalesce(c.cast("double"), F.lit(0.0)) == 0


def active_columns(df: DataFrame) -> list[str]:
    """Columns with any value that is not missing, zero or empty: one pass."""
    row = df.agg(*[F.max(~is_zero(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema.fields]).first()
    return [c for c in df.columns if row[c]]


def flatten(df: DataFrame, matrix: str | None = None, vectors: dict[str, int] | None = None) -> DataFrame:
    """Vectors as columns tag0, tag1, ...; a matrix as one row for each of its rows, with the scalars on the first alone. Floats at single precision."""
    vectors = vectors or {}
    if matrix:
        df = df.select("*", F.posexplode_outer(matrix).alias("_pos", "_row")).drop(matrix)
        scalars = [c for c in df.columns if c not in ("_pos", "_row", *vectors)]
        df = df.select(*[F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col(c)).alias(c) for c in scalars], *vectors, F.col("_row").alias(matrix))
        width = df.agg(F.max(F.size(matrix))).first()[0] or 0
        vectors = {**vectors, matrix: max(width, 0)}
    out = [F.col(c).cast("float").alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c) for c in df.columns if c not in vectors]
    return df.select(*out, *[F.get(c, F.lit(i)).cast("float").alias(f"{c}{i}") for c, n in vectors.items() for i in range(n)])


def write_csv(df: DataFrame, path: str, **how) -> None:
    flat = flatten(df, **how)
    flat.select(*active_columns(flat)).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, **how) -> None:
    flatten(df, **how).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_lines(df: DataFrame, line: str, path: str, order: list[str]) -> None:
    """One line of text for each row, in the order of the columns; part files follow one another. For lexicons, token lists and scripts."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.coalesce(F.col(line).cast("string"), F.lit("")).alias("value")).write.mode("overwrite").text(path)


#: Fields of a status report, in order; the trace is written on demand. Fixed values.
STATUS = ("status", "message", "error", "request")


def write_status(spark: SparkSession, path: str, status: dict[str, object], form: str = "json", trace: bool = False) -> None:
    """The status of a request that failed, as a CSV of Name and Value or as one JSON object; missing fields are ''."""
    fields = [*STATUS, *(["trace"] if trace else [])]
    values = {k: "" if status.get(k) is None else str(status[k]) for k in fields}
    if form == "csv":
        spark.createDataFrame(list(values.items()), "Name string, Value string").coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')
    elif form == "json":
        spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in fields)).coalesce(1).write.mode("overwrite").json(path)
    else:
        raise ValueError("form must be csv or json")


def html_rows(report: DataFrame, columns: list[str]) -> DataFrame:
    """One <tr> for each row; html columns go in as they are."""
    cells = [F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>")) for c in columns]
    return report.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def write_html(report: DataFrame, columns: list[str], path: str) -> None:
    """Part files of table rows, written where they are made."""
    html_rows(report, columns).write.mode("overwrite").text(path)
