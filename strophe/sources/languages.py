"""Tables of languages: the catalogue of languoids, the list of ISO codes, the codes that tools know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places of the columns that are read from the languoid table (comma-separated, with a header). Fixed values.
LANGUOID = {"glotto_id": 0, "family_id": 1, "parent_id": 2, "name": 3, "bookkeeping": 4, "level": 5, "iso3": 8, "country_ids": 14}


def by_place(spark: SparkSession, path: str, places: dict[str, int], sep: str, header: bool) -> DataFrame:
    """Columns by their place; missing values are ''."""
    rows = spark.read.csv(path, sep=sep, header=header, multiLine=True, escape='"')
    return rows.select(*[F.coalesce(F.col(f"`{rows.columns[i]}`"), F.lit("")).alias(n) for n, i in places.items()])


def read_languoids(spark: SparkSession, path: str) -> DataFrame:
    """The languoid table; bookkeeping is true or false."""
    return by_place(spark, path, LANGUOID, ",", True).withColumn("bookkeeping", F.lower("bookkeeping").isin("true", "1", "t"))


def read_iso_codes(spark: SparkSession, path: str) -> DataFrame:
    """iso3, iso1 ('' where there is none) of the tab-separated list of codes."""
    return by_place(spark, path, {"iso3": 0, "iso1": 3}, "\t", True)


def read_tool(spark: SparkSession, path: str, code: int, name: int) -> DataFrame:
    """iso, name of a tool's list (comma-separated, no header), given their places; of a repeated code the last name in order."""
    return by_place(spark, path, {"iso": code, "name": name}, ",", False).groupBy("iso").agg(F.max("name").alias("name"))


def with_short_codes(languoids: DataFrame, codes: DataFrame) -> DataFrame:
    """The languoids with iso1, '' where the list has none."""
    short = codes.select("iso3", "iso1").dropDuplicates(["iso3"])
    return languoids.join(short, "iso3", "left").withColumn("iso1", F.coalesce("iso1", F.lit("")))


def unknown_codes(languoids: DataFrame, codes: DataFrame, tools: dict[str, DataFrame]) -> DataFrame:
    """report, code, name of what does not meet: languoids' codes that the list lacks, codes without a languoid, tools' codes (of either length) that no languoid has."""
    used = languoids.filter("iso3 != ''").select(F.col("iso3").alias("code")).distinct()
    listed = codes.select(F.col("iso3").alias("code")).distinct()
    known = with_short_codes(languoids, codes)
    either = known.select(F.col("iso3").alias("code")).union(known.select("iso1")).filter("code != ''").distinct()

    def report(name, rows):
        return rows.select(F.lit(name).alias("report"), "code", *([F.col("name")] if "name" in rows.columns else [F.lit("").alias("name")]))

    out = report("not in list", used.join(listed, "code", "left_anti")).unionByName(report("not in catalogue", listed.join(used, "code", "left_anti")))
    for name, tool in tools.items():
        out = out.unionByName(report(name, tool.withColumnRenamed("iso", "code").join(either, "code", "left_anti")))
    return out
