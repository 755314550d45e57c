"""Recordings: alignment of known labels, windows with context, decoding with a lexicon. Frames are cut from vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strophe.functions import numbers as nx
from strophe.operators import ctc, lexicon
from strophe.operators.numbering import number
from strophe.queries.views import table
from strophe.registry import query


def frames(spark, d):
    """Eight frames of eight labels from each vector."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ctc.log_softmax(F.slice("embedding", i * 8 + 1, 8)))
    return table(spark, d, "embeddings").select("vec_id", "label", cut.alias("frames"))


@query()
def forced_alignment(spark, d):
    """Three labels by the vector's number and class; no SQL, tests go through all paths."""
    k = F.col("vec_id").cast("int")
    known = frames(spark, d).withColumn("labels", F.array(k % 7 + 1, F.col("label") % 7 + 1, (k + F.col("label")) % 7 + 1))
    return ctc.forced_align(known, "vec_id", "frames", "labels").withColumn("score", F.round("score", 6))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice / 100.0 AS seconds FROM orders), w AS (SELECT o_orderkey, seconds, unnest(generate_series(0, CAST(ceil(seconds / 30.0) AS INT) - 1)) AS w FROM o WHERE seconds > 0)
SELECT o_orderkey, CAST(w AS INT) AS "window", CAST(floor(w * 30.0::DOUBLE * 50.0) AS BIGINT) AS start, CAST(floor(least(w * 30.0::DOUBLE + 30.0, seconds) * 50.0) AS BIGINT) AS stop,
CAST(floor(greatest(w * 30.0::DOUBLE - 3.0, 0.0) * 50.0) AS BIGINT) AS in_start, CAST(floor(least(w * 30.0::DOUBLE + 33.0, seconds) * 50.0) AS BIGINT) AS in_stop FROM w""")
def window_plan(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 100.0).alias("seconds"))
    return ctc.window_plan(o, "o_orderkey", "seconds")


def smooth(x: np.ndarray, radius: int = 3) -> np.ndarray:
    """The mean of the frames around each, as far as there are any."""
    total = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)))
    at = np.arange(len(x))
    lo, hi = np.maximum(at - radius, 0), np.minimum(at + radius + 1, len(x))
    return (total[hi] - total[lo]) / (hi - lo)[:, None]


@query("""WITH n AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq, embedding FROM embeddings)
SELECT label, seq, round(avg(embedding[1]) OVER w, 5) AS a, round(avg(embedding[2]) OVER w, 5) AS b FROM n WINDOW w AS (PARTITION BY label ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def windowed_frames(spark, d):
    """A class's vectors as one recording, smoothed in windows of 16 frames."""
    placed = number(table(spark, d, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 2).alias("value")), ["vec_id"], "seq", keys=["label"], start=0)
    out = ctc.in_windows(placed, "label", "seq", "value", 16, 3, smooth)
    return out.select("label", "seq", nx.rounded(F.get("out", F.lit(0)), 5).alias("a"), nx.rounded(F.get("out", F.lit(1)), 5).alias("b"))


def short_words(spark, d):
    """Words of up to three letters of the conversations, spelled with seven labels, and the lines of them alone."""
    lines = table(spark, d, "conversations").select(F.filter(F.split(F.lower("text"), " "), lambda w: w.rlike("^[a-z]{1,3}$")).alias("words"))
    words = lines.select(F.explode("words").alias("word")).distinct()
    return words.select("word", F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: F.ascii(c) % 7 + 1).alias("labels")), lines


@query("""WITH l AS (SELECT list_concat(list_concat(['<s>'], list_filter(string_split(lower(text), ' '), lambda x: regexp_full_match(x, '[a-z]{1,3}'))), ['</s>']) AS w FROM conversations WHERE text IS NOT NULL),
g AS (SELECT w[i - k : i - 1] AS history, w[i] AS word FROM (SELECT w, i, unnest(generate_series(0, least(3, i) - 1)) AS k FROM (SELECT w, unnest(generate_series(2, len(w))) AS i FROM l))),
c AS (SELECT history, word, count(*) AS n FROM g GROUP BY history, word)
SELECT array_to_string(history, ' ') AS history, word, n, round(log10(n / sum(n) OVER (PARTITION BY history)), 6) AS score FROM c""")
def word_ngrams(spark, d):
    return lexicon.ngrams(short_words(spark, d)[1], "words").select(F.array_join("history", " ").alias("history"), "word", "n", F.round("score", 6).alias("score"))


@query()
def lexicon_decode(spark, d):
    """Eight frames read as short words; no SQL, tests go through all word sequences."""
    words, lines = short_words(spark, d)
    return lexicon.decode(frames(spark, d), "vec_id", "frames", words, lexicon.ngrams(lines, "words"), width=200).withColumn("score", F.round("score", 6))
