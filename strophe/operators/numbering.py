"""Dense numbers and ranks over whole tables, without a task that sees all rows.

Rows are dealt to ranges of the order and sorted there; each range is counted, and a row's number is the count of all
ranges before its own plus its place. The counts, one for each range, are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.lineage import checkpoint

#: Spark's monotonically increasing ids have the partition above these bits and the place in it below.
PLACE_BITS = 33


def number(df: DataFrame, order: Sequence[str], into: str, keys: Sequence[str] = (), start: int = 1) -> DataFrame:
    """The rows with `into`: consecutive numbers from `start` in the order of the columns, apart for each value of the keys.

    Nulls come first, and null keys are one key. Rows that are equal in all the columns get different numbers, in any
    order; columns that tell them apart make the numbers repeatable. A hot key is split like any other range.
    """
    columns = [*keys, *order]
    dealt = checkpoint(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id()))
    sizes = dict(dealt.groupBy(F.shiftright("_at", PLACE_BITS).alias("p")).count().collect())
    parts = sorted(sizes)
    before = dict(zip(parts, accumulate((sizes[p] for p in parts), initial=0), strict=False))
    ranges = df.sparkSession.createDataFrame(sorted(before.items()), "_part long, _before long")
    placed = dealt.withColumn("_part", F.shiftright("_at", PLACE_BITS)).join(F.broadcast(ranges), "_part")
    placed = placed.withColumn("_n", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    if not keys:
        return placed.select(*df.columns, (F.col("_n") + start).alias(into))
    first = placed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_n").alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return placed.join(first, same).select(*df.columns, (F.col("_n") - F.col("_first") + start).alias(into))


def at_ranks(df: DataFrame, value: str, targets: Callable[[Column], list[Column]], by: Sequence[str] = ()) -> DataFrame:
    """by, i, value: for target i of each group the first value, in ascending order with nulls first, that as many rows reach as the target says.

    targets gives from a group's number of rows the numbers wanted (null: none); a target of 0 or less is the first
    row, one beyond the rows has no row in the result. Equal values are counted first, ranges of the values are summed, and only
    the ranges that hold a wanted place are looked into.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    named = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).alias("_v"))
    counts = named.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    dealt = checkpoint(counts.repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v").withColumn("_part", F.shiftright(F.monotonically_increasing_id(), PLACE_BITS)))
    # a row for each range and group; the window is over the ranges that hold rows of a group
    ranges = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_size"))
    w = Window.partitionBy(*keys)
    ranges = ranges.withColumns({"_n": F.sum("_size").over(w), "_end": F.sum("_size").over(w.orderBy("_part"))})
    wanted = ranges.select(*keys, "_part", "_size", "_end", F.posexplode(F.array(*[t.cast("double") for t in targets(F.col("_n"))])).alias("i", "_t"))
    wanted = wanted.withColumn("_t", F.greatest("_t", F.lit(0.5))).filter("_t > _end - _size and _t <= _end")
    inside = same_keys(dealt, wanted, [*keys, "_part"]).select(*keys, "_part", "_v", "_c", "i", "_t", (F.col("_end") - F.col("_size")).alias("_before"))
    reached = inside.withColumn("_reached", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_part", "i").orderBy("_v")))
    found = reached.filter("_t > _reached - _c and _t <= _reached")
    return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "i", F.col("_v").alias(value))


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of equal names, nulls equal; the columns of a and those of b that are no keys."""
    other = b.withColumnsRenamed({k: f"{k}_b" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in keys])
    return a.join(other, on).drop(*[f"{k}_b" for k in keys])
