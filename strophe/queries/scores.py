"""Score statistics, roll-ups, vectors and training selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strophe.functions import numbers as nx
from strophe.operators import stats, training
from strophe.queries.views import SCRIPTS, TIMELINE, WORDS, scripts, table, timeline, words
from strophe.registry import query

T = f"WITH {TIMELINE}"


@query(f"""{T}, x AS (SELECT event_type, -log10(score) AS x FROM timeline WHERE score > 0) SELECT event_type, count(x) AS n, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS stddev, round(min(x), 9) AS min,
  round(greatest(max(x), 0), 9) AS max, round(skewness(x), 6) AS skew, round(kurtosis(x), 6) AS kurtosis FROM x GROUP BY event_type""")
def score_moments(spark, d):
    m = stats.moments(timeline(spark, d).filter("score > 0"), nx.neg_log10(F.col("score")), ["event_type"])
    return m.select("event_type", "n", *[nx.rounded(F.col(c), n).alias(c) for c, n in (("mean", 9), ("stddev", 9), ("min", 9), ("max", 9), ("skew", 6), ("kurtosis", 6))])


SHARES = [0.5, 0.9, 0.99, 0.999]


@query(f"{T}, q AS (SELECT event_type, unnest([0.5, 0.9, 0.99, 0.999]) AS p, unnest(quantile_disc(value, [0.5, 0.9, 0.99, 0.999])) AS q FROM timeline GROUP BY event_type) SELECT event_type, CAST(p AS DOUBLE) AS p, q FROM q")
def score_quantiles(spark, d):
    return stats.quantiles(timeline(spark, d), "value", SHARES, ["event_type"])


@query(f"{T}, h AS (SELECT CAST(trunc(-log10(score)) AS BIGINT) AS bucket, count(*) AS n FROM timeline GROUP BY 1) SELECT bucket, n, round(100.0 * n / (SELECT sum(n) FROM h), 6) AS percent FROM h")
def score_histogram(spark, d):
    h = stats.histogram(timeline(spark, d).withColumn("x", nx.neg_log10(F.col("score"))), "x")
    return h.select("bucket", "n", F.round("percent", 6).alias("percent"))


@query(f"{T} SELECT CASE WHEN score <= 0.0001 THEN 'critical' WHEN score <= 0.001 THEN 'question' ELSE '' END AS class, count(*) AS n FROM timeline GROUP BY 1")
def score_classes(spark, d):
    return timeline(spark, d).groupBy(nx.score_class(F.col("score")).alias("class")).agg(F.count("*").alias("n"))


@query(f"{T} SELECT file_id, char_id // 10 AS word, arg_min(begin_ts, char_id) AS begin_ts, arg_max(end_ts, char_id) AS end_ts, round(avg(score), 5) AS score FROM timeline GROUP BY file_id, char_id // 10")
def word_rollup(spark, d):
    t = timeline(spark, d).withColumn("word", F.floor(F.col("char_id") / 10))
    return stats.roll_up(t, ["file_id", "word"], "char_id", "begin_ts", "end_ts", "score")


@query(f"{T} SELECT file_id, arg_min(begin_ts, char_id) AS begin_ts, arg_max(end_ts, char_id) AS end_ts, round(avg(score), 5) AS score, string_agg(event_type, ' ' ORDER BY char_id) AS joined FROM timeline GROUP BY file_id")
def verse_rollup(spark, d):
    return stats.roll_up(timeline(spark, d), ["file_id"], "char_id", "begin_ts", "end_ts", "score", "event_type")


@query(f"WITH {WORDS} SELECT chapter_num, lower(string_agg(word, ' ' ORDER BY script_id, word_seq)) AS words FROM words WHERE ttype = 'W' GROUP BY chapter_num")
def group_concat(spark, d):
    parts = F.sort_array(F.collect_list(F.struct("script_id", "word_seq", "word")))
    return words(spark, d).filter("ttype = 'W'").groupBy("chapter_num").agg(F.lower(F.array_join(F.transform(parts, lambda s: s["word"]), " ")).alias("words"))


@query("SELECT l_orderkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING max(l_extendedprice) - min(l_extendedprice) > 30000")
def minmax_spread(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.count("*").alias("n"))
    return g.filter("hi - lo > 30000")


@query("SELECT count(*) AS n_rows, count(o_orderkey) AS n_keys, round(sum(o_totalprice), 2) AS total, (SELECT count(DISTINCT l_orderkey) FROM lineitem) = count(*) AS same_orders FROM orders")
def count_sum_validate(spark, d):
    other = table(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("m"))
    mine = table(spark, d, "orders").agg(F.count("*").alias("n_rows"), F.count("o_orderkey").alias("n_keys"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return mine.crossJoin(other).select("n_rows", "n_keys", "total", (F.col("m") == F.col("n_rows")).alias("same_orders"))


@query("""WITH x AS (SELECT s_nationkey AS book, l_linenumber AS chapter, l_quantity - l_tax * 100 AS diff FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT book, chapter, count(*) AS n, round(avg(diff), 6) AS mean, round(stddev_samp(diff), 6) AS stddev, round(quantile_disc(diff, 0.5), 6) AS median FROM x GROUP BY ROLLUP (book, chapter)""")
def diff_rollup(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.select(F.col("s_nationkey").alias("book"), F.col("l_linenumber").alias("chapter"), (F.col("l_quantity") - F.col("l_tax") * 100).alias("diff"))
    median = F.expr("percentile_disc(0.5) within group (order by diff)")
    return x.rollup("book", "chapter").agg(F.count("*").alias("n"), nx.rounded(F.avg("diff"), 6).alias("mean"), F.round(F.stddev_samp("diff"), 6).alias("stddev"), nx.rounded(median, 6).alias("median"))


@query(f"""{T}, w AS (SELECT file_id, char_id // 5 AS word, count(*) FILTER (score <= 0.001) AS n_critical, count(*) AS n_chars, coalesce(sum(CASE WHEN score <= 0.001 THEN -log10(score) END), 0) AS logs, count(*) FILTER (event_type = 'error') AS n_asr FROM timeline GROUP BY file_id, char_id // 5),
l AS (SELECT file_id, arg_max({{'word': word, 'c': n_critical, 'n': n_chars, 'logs': logs}}, (n_critical, -word)) AS w, sum(n_asr) AS n_asr FROM w GROUP BY file_id)
SELECT file_id, w.word AS worst_word, w.c AS n_critical, round(CASE WHEN w.c = w.n THEN 2 * w.logs ELSE w.logs END + 5 * n_asr, 6) AS score FROM l""")
def critical_score(spark, d):
    t = timeline(spark, d).withColumn("word", F.floor(F.col("char_id") / 5))
    return stats.critical_words(t, "file_id", "word", "score", F.col("event_type") == "error", 1e-3).withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS col FROM embeddings), s AS (SELECT label, col, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY label, col)
SELECT vec_id, label, list(CASE WHEN s > 0 THEN round((x - m) / s, 6) ELSE 0 END ORDER BY col) AS zscores FROM c JOIN s USING (label, col) GROUP BY vec_id, label""")
def zscore_cols(spark, d):
    z = stats.zscore_columns(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return z.select("vec_id", "label", F.transform("zscores", lambda x: nx.rounded(x, 6)).alias("zscores"))


@query("SELECT count(*) FILTER (n_chars > 5000) AS over_limit, count(*) AS n, round(sum(strlen(text)) / 1048576.0, 6) AS total_mb FROM documents")
def memory_over_limit(spark, d):
    return table(spark, d, "documents").agg(F.count_if(F.col("n_chars") > 5000).alias("over_limit"), F.count("*").alias("n"), F.round(F.sum(F.octet_length("text")) / 1048576.0, 6).alias("total_mb"))


PRUNE = f"{T}, l AS (SELECT file_id AS script_id, max(score) AS score FROM timeline GROUP BY file_id), w AS (SELECT file_id AS script_id, score FROM timeline)"


@query(f"{PRUNE} SELECT script_id, score FROM l WHERE score > 0.01 AND script_id NOT IN (SELECT script_id FROM w WHERE score < 0.000011)")
def prune_scores(spark, d):
    w = timeline(spark, d).select(F.col("file_id").alias("script_id"), "score")
    lines = w.groupBy("script_id").agg(F.max("score").alias("score"))
    return training.prune(lines, w, 0.01, 0.000011)


@query("SELECT d.lang, d.source, count(*) AS n, sum(d.n_chars)::BIGINT AS chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY d.lang, d.source")
def training_select(spark, d):
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").join(labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi").join(labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars::DOUBLE AS s, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS i FROM documents),
f AS (SELECT source, i, doc_id, s, 0::BIGINT AS batch, 1 AS n FROM o WHERE i = 1 UNION ALL
  SELECT o.source, o.i, o.doc_id, o.s, CASE WHEN f.n >= 16 OR o.s * (f.n + 1) >= 60000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n >= 16 OR o.s * (f.n + 1) >= 60000 THEN 1 ELSE f.n + 1 END
  FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.i = f.i + 1)
SELECT source, batch, count(*) AS n_samples, max(s) * count(*) AS total, list(doc_id ORDER BY s, doc_id) AS keys FROM f GROUP BY source, batch""")
def batch_pack(spark, d):
    return training.pack_batches(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 60_000, 16)


@query(f"WITH {SCRIPTS}, d AS (SELECT person, length(script_text) AS n FROM scripts) SELECT person, count(*) AS n, round(avg(n), 6) AS mean, round(coalesce(stddev_pop(n), 0), 6) AS sigma, max(n) AS longest FROM d GROUP BY person")
def speaker_lengths(spark, d):
    n = F.length("script_text").cast("long")
    return scripts(spark, d).groupBy("person").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("sigma"), F.max(n).alias("longest"))


@query("""WITH b AS (SELECT label, vec_id, list_position(embedding, list_max(embedding)) - 1 AS best FROM embeddings), m AS (SELECT *, lag(best) OVER (PARTITION BY label ORDER BY vec_id, best) AS p FROM b)
SELECT label, coalesce(list(best ORDER BY vec_id, best) FILTER (best <> 0 AND (p IS NULL OR best <> p)), []) AS path FROM m GROUP BY label""")
def greedy_decode(spark, d):
    best = table(spark, d, "embeddings").select("label", "vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("best"))
    w = Window.partitionBy("label").orderBy("vec_id", "best")
    starts = (F.row_number().over(w) == 1) | (F.col("best") != F.lag("best").over(w))
    marked = best.withColumn("starts", starts).withColumn("at", F.when(F.col("starts") & (F.col("best") != 0), F.struct("vec_id", "best")))
    return marked.groupBy("label").agg(F.transform(F.sort_array(F.collect_list("at")), lambda s: s["best"]).alias("path"))
