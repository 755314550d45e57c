"""Reports, spans and merged timestamps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strophe.functions import diff, numbers as nx
from strophe.operators import ordered, reports
from strophe.queries.views import TIMELINE, table, timeline
from strophe.registry import query

T = f"WITH {TIMELINE}"


@query(f"""{T}, e AS (SELECT -log10(score) AS x FROM timeline), m AS (SELECT count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS mi, greatest(max(x), 0) AS ma, skewness(x) AS sk, kurtosis(x) AS ku FROM e),
named AS (SELECT unnest([{{'p': 0, 'label': 'Mean', 'v': mean}}, {{'p': 1, 'label': 'StdDev', 'v': sd}}, {{'p': 2, 'label': 'Minimum', 'v': mi}}, {{'p': 3, 'label': 'Maximum', 'v': ma}}, {{'p': 4, 'label': 'Skewness', 'v': sk}}, {{'p': 5, 'label': 'Kurtosis', 'v': ku}}]) AS r FROM m),
shares AS (SELECT unnest([{", ".join(str(s) for s in reports.SHARES)}]) AS p), q AS (SELECT p, (SELECT quantile_disc(x, p) FROM e) AS v FROM shares), h AS (SELECT CAST(trunc(x) AS BIGINT) AS b, 100.0 * count(*) / (SELECT count(*) FROM e) AS v FROM e GROUP BY 1)
SELECT 'moments' AS section, CAST(r.p AS DOUBLE) AS place, r.label AS label, printf('%.2f', r.v) AS value FROM named
UNION ALL SELECT 'percentiles', CAST(p AS DOUBLE), 'Percentile ' || printf('%.2f', CAST(p AS DOUBLE) * 100), printf('%.2f', CAST(v AS DOUBLE)) FROM (SELECT p, list_sort(xs)[CAST(greatest(ceil(CAST(p AS DECIMAL(10,4)) * len(xs)), 1) AS INT)] AS v FROM shares, (SELECT list(x) AS xs FROM e))
UNION ALL SELECT 'histogram', CAST(b AS DOUBLE), 'Cat: ' || b || '-' || (b + 1), printf('%.4f', v) FROM h""")
def score_report(spark, d):
    return reports.score_report(timeline(spark, d), F.col("score"))


CHARS = f"""{T}, c AS (SELECT file_id, char_id // 5 AS word, char_id, substr('abcde fgh', CAST(char_id % 9 + 1 AS INT), 1) AS ch, score, begin_ts, end_ts, event_type = 'error' AS is_asr, value > 90 AS silent FROM timeline)"""


@query(f"""{CHARS}, w AS (SELECT file_id, word, count(*) FILTER (score <= 0.001) AS n, count(*) AS m, coalesce(sum(CASE WHEN score <= 0.001 THEN -log10(score) END), 0) AS logs, count(*) FILTER (is_asr AND ch <> ' ') AS heard FROM c GROUP BY file_id, word),
l AS (SELECT file_id, arg_max({{'n': n, 'm': m, 'logs': logs}}, (n, -word)) AS w, sum(heard) AS heard FROM w GROUP BY file_id),
s AS (SELECT file_id, CASE WHEN w.n = w.m THEN 2 * w.logs ELSE w.logs END + 5 * heard AS score FROM l),
t AS (SELECT file_id, arg_min(begin_ts, char_id) AS begin_ts, arg_max(end_ts, char_id) AS end_ts, string_agg(CASE WHEN score <= 0.001 THEN '<span class="red-box">' || ch || '</span>' WHEN score <= 0.01 THEN '<span class="yellow-box">' || ch || '</span>'
  WHEN silent THEN '<span class="green-box">' || ch || '</span>' WHEN is_asr AND ch <> ' ' THEN '<span class="blue-box">' || ch || '</span>' ELSE ch END, '' ORDER BY char_id) AS html FROM c GROUP BY file_id)
SELECT file_id, round(s.score, 6) AS score, begin_ts, end_ts, html FROM s JOIN t USING (file_id) WHERE s.score > 0""")
def proof_report(spark, d):
    k = F.col("char_id")
    c = timeline(spark, d).select("file_id", F.floor(k / 5).alias("word"), k, F.substr(F.lit("abcde fgh"), (k % 9 + 1).cast("int"), F.lit(1)).alias("ch"), "score", "begin_ts", "end_ts", (F.col("event_type") == "error").alias("is_asr"), (F.col("value") > 90).alias("silent"))
    return reports.proof_report(c, "file_id", "word", "char_id", F.col("silent"), critical=1e-3, question=1e-2).withColumn("score", F.round("score", 6))


@query("""WITH f AS (SELECT DISTINCT o_orderpriority, 'B' || (o_orderkey % 4) AS book, o_orderkey % 7 AS chapter FROM orders)
SELECT o_orderpriority, 'let fileMap = {' || chr(10) || string_agg(chr(9) || '''' || book || chapter || ''': ''' || book || '_' || chapter || '.mp3''', ',' || chr(10) ORDER BY book, chapter) || '};' || chr(10) AS script FROM f GROUP BY o_orderpriority""")
def chapter_file_map(spark, d):
    k = F.col("o_orderkey")
    f = table(spark, d, "orders").select("o_orderpriority", F.concat(F.lit("B"), (k % 4).cast("string")).alias("book"), (k % 7).alias("chapter"))
    f = f.withColumn("file", F.concat("book", F.lit("_"), F.col("chapter").cast("string"), F.lit(".mp3")))
    return reports.file_map(f, "o_orderpriority", "book", "chapter", "file")


@query("SELECT item_id, round(CASE WHEN text = '' THEN NULL ELSE (3 + 2) * 100 / ((strlen(text) + 3 + strlen(text) + 4) / 2.0) END, 9) AS error_percent FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)")
def error_percent(spark, d):
    t = F.coalesce("text", F.lit(""))
    b = table(spark, d, "benchmark").filter(t != "").select("item_id", F.concat(t, F.lit("###")).alias("base"), F.concat(F.lit("ÿÿ"), t).alias("comp"))
    both = b.withColumn("diffs", diff.char_diff("base", "comp"))
    return both.select("item_id", F.round(diff.error_percent(F.col("diffs"), F.col("base"), F.col("comp")), 9).alias("error_percent"))


@query(f"{T}, c AS (SELECT file_id, char_id, char_id % 4 AS char_seq, event_type, score, row_number() OVER (PARTITION BY file_id ORDER BY char_id) AS i FROM timeline) SELECT file_id, char_id, 1 AS part, event_type AS ch, score FROM c UNION ALL SELECT file_id, char_id, 0, ' ', 1.0 FROM c WHERE char_seq = 0 AND i > 1")
def word_start_spaces(spark, d):
    c = timeline(spark, d).withColumn("char_seq", F.col("char_id") % 4)
    return ordered.spaces_at_word_starts(c, "file_id", "char_id", "char_seq", "event_type")


SEGMENTS = "seg AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seg, CASE WHEN l_partkey % 3 = 0 THEN '<blank>' ELSE 'x' END AS label, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS stop FROM lineitem)"


@query(f"""WITH {SEGMENTS}, s AS (SELECT *, lag(label) OVER w AS pl, lag(start) OVER w AS ps, lag(stop) OVER w AS pe, lead(label) OVER w AS nl, lead(start) OVER w AS ns, lead(stop) OVER w AS ne FROM seg WINDOW w AS (PARTITION BY k ORDER BY seg)),
v AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seg) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM s WHERE label <> '<blank>'), b AS (SELECT *, i // 2 AS token, (n - 1) // 2 AS last FROM v)
SELECT a.k, a.token, CAST(CASE WHEN a.pl = '<blank>' THEN CASE WHEN a.token = 0 THEN a.ps ELSE (a.ps + a.pe) // 2 END ELSE a.start END AS BIGINT) AS "begin", CAST(CASE WHEN z.nl = '<blank>' THEN CASE WHEN z.token = z.last THEN z.ne ELSE (z.ns + z.ne) // 2 END ELSE z.stop END AS BIGINT) AS "end"
FROM b a JOIN b z ON a.k = z.k AND a.token = z.token WHERE a.i % 2 = 0 AND (z.i % 2 = 1 OR z.i = z.n - 1)""")
def label_spans(spark, d):
    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    start = (F.col("l_linenumber") * 10).cast("long")
    seg = li.select(F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("seg"), F.when(F.col("l_partkey") % 3 == 0, "<blank>").otherwise("x").alias("label"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("stop"))
    # tokens of two labels, the last of what is left
    n = seg.filter("label != '<blank>'").groupBy("k").agg(F.count("*").alias("n"))
    tokens = n.select("k", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 2))).alias("token")).select("k", "token", F.least(F.lit(2), F.col("n") - 2 * F.col("token")).alias("n_labels"))
    return ordered.label_spans(seg, tokens, "k")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS k, l_linenumber AS v, min(l_partkey % 100)::DOUBLE AS b, min(CASE WHEN l_suppkey % 3 = 0 THEN -1 ELSE l_partkey % 100 + 5 END)::DOUBLE AS e FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1, 2),
h AS (SELECT l_orderkey AS k, l_linenumber AS v, min(l_quantity)::DOUBLE AS b, min(l_quantity)::DOUBLE + 2 AS e FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1, 2),
j AS (SELECT coalesce(s.k, h.k) AS k, coalesce(s.v, h.v) AS v, s.b AS sb, s.e AS se, h.b AS hb, h.e AS he, row_number() OVER (PARTITION BY coalesce(s.k, h.k) ORDER BY coalesce(s.v, h.v)) AS i FROM s FULL JOIN h ON s.k = h.k AND s.v = h.v),
m AS (SELECT k, 0::BIGINT AS i, 0 AS v, 0.0::DOUBLE AS b, 0.0::DOUBLE AS e FROM (SELECT DISTINCT k FROM j) UNION ALL
  SELECT j.k, j.i, j.v, CASE WHEN j.sb IS NULL THEN j.hb + m.e WHEN j.sb = -1 AND j.hb IS NOT NULL THEN j.hb + m.e ELSE j.sb END, CASE WHEN j.se IS NULL THEN j.he + m.e WHEN j.se = -1 AND j.he IS NOT NULL THEN j.he + m.e ELSE j.se END FROM m JOIN j ON j.k = m.k AND j.i = m.i + 1)
SELECT k, v, round(b, 6) AS begin_ts, round(e, 6) AS end_ts FROM m WHERE i > 0""")
def merged_timestamps(spark, d):
    li = table(spark, d, "lineitem").withColumns({"k": F.col("l_orderkey"), "v": F.col("l_linenumber")})
    start = (F.col("l_partkey") % 100).cast("double")
    s = li.filter("l_partkey % 4 != 0").groupBy("k", "v").agg(F.min(start).alias("begin_ts"), F.min(F.when(F.col("l_suppkey") % 3 == 0, -1.0).otherwise(start + 5)).alias("end_ts"))
    h = li.filter("l_suppkey % 2 = 0").groupBy("k", "v").agg(F.min("l_quantity").cast("double").alias("begin_ts"), (F.min("l_quantity").cast("double") + 2).alias("end_ts"))
    return ordered.merge_timestamps(s, h, "k", "v").select("k", "v", F.round("begin_ts", 6).alias("begin_ts"), F.round("end_ts", 6).alias("end_ts"))


@query("SELECT vec_id, list_concat(embedding[1:60], [0.0::FLOAT, 0.0::FLOAT, 0.0::FLOAT, 0.0::FLOAT]) AS padded, [1 for _ in range(64)] AS mask FROM embeddings")
def pad_mask(spark, d):
    part = F.slice("embedding", 1, 60)
    return table(spark, d, "embeddings").select("vec_id", nx.pad_to(part, 64).cast("array<float>").alias("padded"), nx.pad_mask(part, 64).alias("mask"))


@query("SELECT event_id, 2 * (10.0 + CASE WHEN event_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 240 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 20 ELSE 0 END) * CASE WHEN event_id % 7 = 0 THEN 0.15 ELSE 1 END AS minutes, value > 2 * (10.0 + CASE WHEN event_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 240 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 20 ELSE 0 END) * CASE WHEN event_id % 7 = 0 THEN 0.15 ELSE 1 END AS is_over FROM events")
def run_alarms(spark, d):
    k = F.col("event_id")
    minutes = nx.expected_minutes(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0)
    return table(spark, d, "events").select(k, F.round(minutes, 6).alias("minutes"), (F.col("value") > minutes).alias("is_over"))
