"""Score statistics and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators import numbering


def moments(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sample deviation, minimum, maximum (0 at least), bias-corrected skew and excess kurtosis."""
    x = df.select(*by, value.cast("double").alias("x")).groupBy(*by) if by else df.select(value.cast("double").alias("x"))
    got = x.agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev"), F.min("x").alias("min"),
        F.greatest(F.max("x"), F.lit(0.0)).alias("max"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"),
    )
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return got.select(*by, "n", "mean", "stddev", "min", "max", skew.alias("skew"), kurt.alias("kurtosis"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank quantiles, one row for each share: the first value that `p` of the group's values reach; nulls do not count, and a group without values has null.

    Ranges of the values are counted, so no task sees all values of a group.
    """
    known = df.filter(F.col(value).isNotNull())
    found = numbering.at_ranks(known, value, lambda n: [n * F.lit(float(p)) for p in shares], by).select(*by, "i", F.col(value).cast("double").alias("q"))
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)])
    groups = df.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, F.inline(rows))
    keys = [*by, "i"]
    other = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    return groups.join(other, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left").select(*by, "p", "q")


def histogram(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """bucket (value cut to an integer), n, percent of the group's rows."""
    counts = df.groupBy(*by, F.col(value).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    if by:
        return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    # one row of totals, whatever the input
    total = counts.agg(F.sum("n").alias("all_n"))
    return counts.crossJoin(F.broadcast(total)).select("bucket", "n", (100.0 * F.col("n") / F.col("all_n")).alias("percent"))


def roll_up(df: DataFrame, by: Sequence[str], order: str, begin: str, end: str, score: str, text: str | None = None, digits: int = 5) -> DataFrame:
    """First begin, last end, mean score rounded, and the text joined in order."""
    aggs = [F.min_by(begin, order).alias("begin_ts"), F.max_by(end, order).alias("end_ts"), F.round(F.avg(score), digits).alias("score")]
    if text:
        aggs.append(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text]), " ").alias("joined"))
    return df.groupBy(*by).agg(*aggs)


def best_row(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The row with the greatest value of each group, ties to the first in order."""
    row = F.struct(*df.columns)
    return df.groupBy(*by).agg(F.max_by(row, F.struct(F.col(value), -F.col(order))).alias("r")).select("r.*")


def zscore_columns(df: DataFrame, key: str, vector: str, by: str) -> DataFrame:
    """Each vector's elements as population z-scores of their column within the group; a constant column gives 0."""
    cells = df.select(key, by, F.posexplode(vector).alias("col", "x")).withColumn("x", F.col("x").cast("double"))
    stats = cells.groupBy(by, "col").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = cells.join(stats, [by, "col"]).withColumn("z", F.when(F.col("s") > 0, (F.col("x") - F.col("m")) / F.col("s")).otherwise(0.0))
    return z.groupBy(by, key).agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "z"))), lambda c: c["z"]).alias("zscores"))


def critical_words(df: DataFrame, line: str, word: str, score: str, is_asr: Column, critical: float = 1e-4) -> DataFrame:
    """For each line the word with most critical characters: their summed -log10, doubled if all are critical, plus 5 for each ASR character of the line."""
    bad = F.col(score) <= critical
    words = df.groupBy(line, word).agg(
        F.count_if(bad).alias("n_critical"), F.count("*").alias("n_chars"),
        F.coalesce(F.sum(F.when(bad, -F.log10(F.greatest(F.col(score), F.lit(1e-30))))), F.lit(0.0)).alias("logs"), F.count_if(is_asr).alias("n_asr"),
    )
    worst = F.max_by(F.struct(word, "n_critical", "n_chars", "logs"), F.struct(F.col("n_critical"), -F.col(word)))
    lines = words.groupBy(line).agg(worst.alias("w"), F.sum("n_asr").alias("n_asr"))
    doubled = F.when(F.col("w.n_critical") == F.col("w.n_chars"), 2 * F.col("w.logs")).otherwise(F.col("w.logs"))
    return lines.select(line, F.col(f"w.{word}").alias("worst_word"), F.col("w.n_critical").alias("n_critical"), (doubled + 5 * F.col("n_asr")).alias("score"))
