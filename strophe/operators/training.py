"""Training selection: vocabularies, pruning, batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_index(chars: DataFrame) -> DataFrame:
    """token, id: "|" is 0, the distinct characters (ch) in order from 1, then [UNK] and [PAD]. An alphabet is small, so one ordered window will do."""
    spark = chars.sparkSession
    known = chars.select("ch").distinct().select(F.col("ch").alias("token"), F.row_number().over(Window.orderBy("ch")).cast("long").alias("id"))
    n = known.agg(F.count("*").alias("n"))
    ends = n.select(F.inline(F.array(F.struct(F.lit("[UNK]").alias("token"), (F.col("n") + 1).alias("id")), F.struct(F.lit("[PAD]").alias("token"), (F.col("n") + 2).alias("id")))))
    return spark.createDataFrame([("|", 0)], "token string, id long").unionByName(known).unionByName(ends)


def prune(lines: DataFrame, words: DataFrame, line_score: float = 0.2, word_score: float = 0.01) -> DataFrame:
    """Lines scored over line_score that hold no word under word_score."""
    bad = words.filter(F.col("score") < word_score).select("script_id").distinct()
    return lines.filter(F.col("score") > line_score).join(bad, "script_id", "left_anti")


def pack_batches(samples: DataFrame, group: str, key: str, size: str, target: float, most: int) -> DataFrame:
    """group, batch, n_samples, total (largest size x samples), keys: samples in ascending size fill a batch until `most` of them, or until one more would pass the target.

    The packing is a left fold over sizes. It needs no rows, only how many samples of each size a group has, and equal
    sizes fill equal batches: so the fold runs over different sizes, and gives for each at most three stretches of
    ranks; rows then find their batch by their rank among equal sizes.
    """
    kind = samples.schema[group].dataType.simpleString()
    rows = samples.select(group, key, F.col(size).cast("double").alias(size))

    def stretches(pdf: pd.DataFrame) -> pd.DataFrame:
        out, batch, n = [], 0, 0
        for s, left in sorted(zip(pdf[size], pdf["n"], strict=True)):
            rank = 0
            room = max(1, min(most, math.ceil(target / s) - 1 if s > 0 else most))
            while left:
                if n >= room:
                    batch, n = batch + 1, 0
                if n == 0 and left >= room:
                    full = left // room
                    out.append((s, rank, rank + full * room, batch, room))
                    batch, rank, left = batch + full, rank + full * room, left - full * room
                else:
                    take = min(left, room - n)
                    out.append((s, rank, rank + take, batch, take))
                    n, rank, left = n + take, rank + take, left - take
        found = pd.DataFrame(out, columns=[size, "first", "end", "batch", "width"])
        found.insert(0, group, pdf[group].iat[0])
        return found

    counts = rows.groupBy(group, size).agg(F.count("*").alias("n"))
    spans = counts.groupBy(group).applyInPandas(stretches, f"{group} {kind}, {size} double, first long, end long, batch long, width long")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group, size).orderBy(key)) - 1)
    same = ranked[group].eqNullSafe(spans[group]) & (ranked[size] == spans[size]) & (ranked["rank"] >= spans["first"]) & (ranked["rank"] < spans["end"])
    dealt = ranked.join(spans, same).select(ranked[group], ranked[size], ranked[key], (F.col("batch") + F.floor((F.col("rank") - F.col("first")) / F.col("width"))).alias("batch"))
    packed = dealt.groupBy(group, "batch").agg(F.count("*").alias("n_samples"), (F.max(size) * F.count("*")).alias("total"), F.sort_array(F.collect_list(F.struct(size, key))).alias("k"))
    return packed.select(group, "batch", "n_samples", "total", F.transform("k", lambda s: s[key]).alias("keys"))
