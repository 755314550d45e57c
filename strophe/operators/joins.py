"""Joins with the dataset's conventions: last duplicate wins, missing is '' or 0, durations match within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.lineage import checkpoint
from strophe.operators import numbering


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key, the one with the greatest order value."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def full_outer_compare(base: DataFrame, comp: DataFrame, keys: Sequence[str], text: str, order: str) -> DataFrame:
    """keys, base_text, comp_text of both sides; missing text is ''. The last duplicate of the compared side counts."""
    b = base.select(*keys, F.col(text).alias("base_text"))
    c = last_wins(comp.select(*keys, order, text), keys, order).select(*keys, F.col(text).alias("comp_text"))
    return b.join(c, list(keys), "full_outer").select(*keys, F.coalesce("base_text", F.lit("")).alias("base_text"), F.coalesce("comp_text", F.lit("")).alias("comp_text"))


def duration_match(source: DataFrame, target: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """keys, status: match, duration mismatch, or missing target duration."""
    t = target.select(*keys, F.col("duration").alias("target_duration"))
    status = F.when(F.col("target_duration").isNull(), "missing target duration").when(F.abs(F.col("duration") - F.col("target_duration")) <= tolerance, "match")
    return source.join(t, list(keys), "left").select(*keys, status.otherwise("duration mismatch").alias("status"))


def range_join(points: DataFrame, ranges: DataFrame, key: str, at: str, lo: str, hi: str) -> DataFrame:
    """Points inside [lo, hi] of a range with the same key: an equi-join with the bounds as its condition."""
    r = ranges.withColumnRenamed(key, "_key")
    return points.join(r, (F.col(key) == F.col("_key")) & F.col(at).between(F.col(lo), F.col(hi))).drop("_key")


def one_each(changes: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    """Changes with one row for each key: the last in `order`; without an order, repeated keys raise."""
    if order is not None:
        return last_wins(changes, keys, order).select(*changes.columns)
    changes = checkpoint(changes)  # read twice: for the check and for the join
    if not changes.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError("changes repeat a key; name the column that orders them")
    return changes


def keyed_update(target: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], expect_all: bool = False, order: str | None = None) -> DataFrame:
    """The target with the columns of matching changes; with expect_all, every change must meet one row of the target."""
    changes = one_each(changes, keys, order)
    if expect_all:
        met = changes.select(*keys).join(target.groupBy(*keys).agg(F.count("*").alias("_n")), list(keys), "left")
        if not met.filter("_n is null or _n != 1").isEmpty():
            raise ValueError("an update did not meet exactly one row")
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    kept = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return target.join(new, list(keys), "left").withColumns(kept).select(*target.columns)


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of changes replace rows with their keys."""
    changes = one_each(changes, keys, order)
    return target.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)


def upsert_if_changed(target: DataFrame, changes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value and action of every key: "insert" where it is new, "update" where the value differs, "" where nothing is done."""
    new = one_each(changes, keys, None).select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_change"))
    both = target.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_there")).join(new, list(keys), "full_outer")
    action = F.when(F.col("_there").isNull(), "insert").when(F.col("_change") & ~F.col("_old").eqNullSafe(F.col("_new")), "update").otherwise("")
    return both.select(*keys, F.when(F.col("_change"), F.col("_new")).otherwise(F.col("_old")).alias(value), action.alias("action"))


def insert_new(target: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows whose key is 0 with new keys from the target's greatest on, in order; rows with a key are there already. Numbered by ranges, so any number of rows can be new."""
    top = target.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = numbering.number(rows.filter(F.col(key) == 0), order, "_n")
    return numbered.crossJoin(F.broadcast(top)).withColumn(key, (F.col("_top") + F.col("_n")).cast(target.schema[key].dataType)).select(*rows.columns)


def cascade_delete(parent: DataFrame, child: DataFrame, key: str, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parent and child without the doomed keys."""
    return parent.join(doomed, key, "left_anti"), child.join(doomed, key, "left_anti")


def priority_pick(df: DataFrame, by: Sequence[str], kind: str, preference: Sequence[str], order: str) -> DataFrame:
    """One row for each group: the kind first in the preference, then the first in order; other kinds do not count."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(kind))
    w = Window.partitionBy(*by).orderBy("_rank", order)
    return df.withColumn("_rank", rank).filter("_rank > 0").withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_rank", "_i")
