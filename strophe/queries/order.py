"""Ordered analytics over the timeline."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strophe.operators import joins, ordered, stats
from strophe.queries.views import SCRIPTS, TIMELINE, scripts, table, timeline
from strophe.registry import query

T = f"WITH {TIMELINE}"
W = "PARTITION BY file_id ORDER BY begin_ts, char_id"
ORDER = ["begin_ts", "char_id"]


@query(f"{T} SELECT file_id, char_id, round(coalesce(lead(begin_ts) OVER ({W}) - end_ts, 100000 + file_id - end_ts), 6) AS gap FROM timeline")
def lead_gap(spark, d):
    t = timeline(spark, d)
    # the files' durations
    durations = t.select("file_id").distinct().withColumn("duration", F.col("file_id") + 100_000.0)
    return ordered.lead_gap(t, "file_id", ORDER, "begin_ts", "end_ts", durations).select("file_id", "char_id", F.round("gap", 6).alias("gap"))


GAPS = f"{T}, g AS (SELECT file_id, char_id, event_type, coalesce(lead(begin_ts) OVER ({W}) - end_ts, 0) AS gap FROM timeline)"


@query(f"{GAPS} SELECT event_type, round(avg(gap) + 4 * stddev_samp(gap), 6) AS limit_ FROM g GROUP BY event_type")
def class_limits(spark, d):
    g = ordered.lead_gap(timeline(spark, d), "file_id", ORDER, "begin_ts", "end_ts")
    return ordered.outlier_limits(g, "event_type", "gap").select("event_type", F.round("limit_", 6).alias("limit_"))


@query(f"{GAPS}, l AS (SELECT event_type, avg(gap) + 2 * stddev_samp(gap) AS limit_ FROM g GROUP BY event_type) SELECT char_id, coalesce(gap >= limit_, false) AS is_outlier FROM g JOIN l USING (event_type)")
def outliers(spark, d):
    g = ordered.lead_gap(timeline(spark, d), "file_id", ORDER, "begin_ts", "end_ts")
    return ordered.flag_outliers(g, "event_type", "gap", 2.0).select("char_id", "is_outlier")


@query(f"""{T}, c AS (SELECT file_id, char_id, begin_ts, event_type, CASE WHEN lag(event_type) OVER ({W}) IS NOT DISTINCT FROM event_type AND row_number() OVER ({W}) > 1 THEN 0 ELSE 1 END AS ch FROM timeline),
i AS (SELECT *, sum(ch) OVER ({W}) AS island FROM c) SELECT file_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n, min(char_id) AS first_id FROM i GROUP BY file_id, island, event_type""")
def islands(spark, d):
    i = ordered.islands(timeline(spark, d), "file_id", ORDER, "event_type")
    return i.groupBy("file_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("char_id").alias("first_id"))


@query(f"{T} SELECT char_id, round(coalesce((begin_ts + lag(end_ts) OVER ({W})) / 2, 0), 3) AS new_begin, round(coalesce((end_ts + lead(begin_ts) OVER ({W})) / 2, 90000), 3) AS new_end FROM timeline")
def midpoint(spark, d):
    m = ordered.midpoint_smooth(timeline(spark, d), "file_id", ORDER, "begin_ts", "end_ts", F.lit(90_000.0))
    return m.select("char_id", F.round("new_begin", 3).alias("new_begin"), F.round("new_end", 3).alias("new_end"))


@query(f"{T} SELECT char_id, begin_ts, lead(begin_ts, 1, 0) OVER ({W}) AS end_ts FROM timeline")
def lead_end(spark, d):
    return timeline(spark, d).select("char_id", "begin_ts", F.lead("begin_ts", 1, 0.0).over(Window.partitionBy("file_id").orderBy(*ORDER)).alias("end_ts"))


NEAR = f"""{T}, p AS (SELECT * FROM timeline WHERE event_type = 'error'), f AS (SELECT * FROM timeline WHERE event_type <> 'error')"""


@query(f"""{NEAR}, a AS (SELECT p.char_id, p.begin_ts AS t, f.char_id AS fid, f.begin_ts AS ft, row_number() OVER (PARTITION BY p.char_id ORDER BY abs(p.begin_ts - f.begin_ts), f.begin_ts) AS i FROM p LEFT JOIN f USING (file_id))
SELECT char_id, fid AS frame_id, ft AS frame_ts FROM a WHERE i = 1""")
def nearest_frame(spark, d):
    t = timeline(spark, d)
    frames = t.filter("event_type != 'error'").select("file_id", F.col("begin_ts").alias("frame_ts"), F.col("char_id").alias("frame_id"))
    points = t.filter("event_type = 'error'").select("file_id", "char_id", "begin_ts")
    return ordered.nearest(points, frames, "file_id", "begin_ts", "frame_ts", ["frame_id"]).select("char_id", "frame_id", "frame_ts")


@query(f"{NEAR} SELECT p.char_id, f.char_id AS frame_id, f.begin_ts AS frame_ts FROM p ASOF JOIN f ON p.file_id = f.file_id AND p.begin_ts <= f.begin_ts")
def forward_frame(spark, d):
    t = timeline(spark, d)
    frames = t.filter("event_type != 'error'").select("file_id", F.col("begin_ts").alias("frame_ts"), F.col("char_id").alias("frame_id"))
    points = t.filter("event_type = 'error'").select("file_id", "char_id", "begin_ts")
    return ordered.forward(points, frames, "file_id", "begin_ts", "frame_ts", ["frame_id"]).select("char_id", "frame_id", "frame_ts")


SILENCE = f"{T}, s AS (SELECT *, coalesce(lead(begin_ts) OVER ({W}) - end_ts, 100000 - end_ts) AS silence FROM timeline)"


@query(f"{SILENCE} SELECT char_id, round(silence, 6) AS silence FROM s")
def silence(spark, d):
    t = timeline(spark, d).withColumn("file_end", F.lit(100_000.0))
    return ordered.word_silence(t, "file_id", ORDER, "begin_ts", "end_ts", "file_end").select("char_id", F.round("silence", 6).alias("silence"))


@query(f"""{SILENCE}, v AS (SELECT *, coalesce(lag(char_id // 3) OVER ({W}) IS DISTINCT FROM char_id // 3 AND lag(char_id) OVER ({W}) IS NOT NULL, false) AS is_first FROM s),
r AS (SELECT *, sum(CASE WHEN is_first THEN 0 ELSE 1 END) OVER ({W}) AS run FROM v)
SELECT char_id, round(max(silence) OVER (PARTITION BY file_id, run ORDER BY begin_ts, char_id), 6) AS carried FROM r""")
def carry_last(spark, d):
    t = ordered.word_silence(timeline(spark, d).withColumn("file_end", F.lit(100_000.0)), "file_id", ORDER, "begin_ts", "end_ts", "file_end")
    t = t.withColumn("verse", F.floor(F.col("char_id") / 3))
    return ordered.carry_last(t, "file_id", ORDER, "verse", "silence").select("char_id", F.round("carried", 6).alias("carried"))


@query(f"{SILENCE} SELECT char_id, round(silence, 6) AS silence FROM s ORDER BY s.silence DESC, char_id LIMIT 400")
def topk_silence(spark, d):
    t = ordered.word_silence(timeline(spark, d).withColumn("file_end", F.lit(100_000.0)), "file_id", ORDER, "begin_ts", "end_ts", "file_end")
    return t.orderBy(F.desc("silence"), "char_id").limit(400).select("char_id", F.round("silence", 6).alias("silence"))


@query(f"{SILENCE} SELECT file_id, arg_max(char_id, (silence, -char_id)) AS char_id, round(max(silence), 6) AS silence FROM s GROUP BY file_id")
def max_silence(spark, d):
    t = ordered.word_silence(timeline(spark, d).withColumn("file_end", F.lit(100_000.0)), "file_id", ORDER, "begin_ts", "end_ts", "file_end")
    return stats.best_row(t.select("file_id", "char_id", "silence"), ["file_id"], "silence", "char_id").select("file_id", "char_id", F.round("silence", 6).alias("silence"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 1000 + l_partkey % 1000 AS BIGINT) AS off FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(lead(off) OVER (PARTITION BY l_orderkey ORDER BY off), 10000) - off AS n_bytes FROM f""")
def byte_ranges(spark, d):
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("off"), F.lit(10_000).cast("long").alias("size"))
    return ordered.byte_ranges(f, "l_orderkey", "off", "size").select("l_orderkey", "l_linenumber", "n_bytes")


@query(f"{T}, r AS (SELECT event_type, score, row_number() OVER (PARTITION BY event_type ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM timeline) SELECT event_type, score FROM r WHERE i = floor(n * 0.1)")
def order_stat(spark, d):
    return ordered.order_statistic(timeline(spark, d), "event_type", "score", 0.1)


@query("SELECT l_orderkey, l_linenumber, l_returnflag || CASE WHEN n = 1 THEN '' ELSE chr(CAST(n + 95 AS INT)) END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)")
def dup_suffix(spark, d):
    out = ordered.duplicate_suffix(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_returnflag")
    return out.select("l_orderkey", "l_linenumber", "unique_name")


@query("WITH b AS (SELECT n_nationkey, n_regionkey, n_nationkey % 5 + 1 AS chapters FROM nation) SELECT n_nationkey, CAST(coalesce(sum(chapters) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS ordinal FROM b")
def canonical_seq(spark, d):
    b = table(spark, d, "nation").withColumn("chapters", F.col("n_nationkey") % 5 + 1)
    before = Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, -1)
    return b.select("n_nationkey", (F.coalesce(F.sum("chapters").over(before), F.lit(0)) + 1).cast("long").alias("ordinal"))


@query(f"WITH {SCRIPTS}, g AS (SELECT *, sum(CASE WHEN person = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY chapter_num ORDER BY verse_num) AS grp FROM scripts) SELECT chapter_num, CAST(grp AS BIGINT) AS grp, count(*) AS n_lines, string_agg(script_text, ' ' ORDER BY verse_num) AS grouped_text FROM g GROUP BY chapter_num, grp")
def line_groups(spark, d):
    return ordered.line_groups(scripts(spark, d), "chapter_num", ["verse_num"], F.col("person") == "user", "script_text")


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN -1.0 ELSE l_linenumber * 10.0 END AS b, CASE WHEN l_suppkey % 4 = 0 THEN -1.0 ELSE l_linenumber * 10.0 + 8 END AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN b = -1 THEN coalesce(last_value(CASE WHEN e <> -1 THEN e END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE b END AS DOUBLE) AS fixed_begin,
  CAST(CASE WHEN e = -1 THEN coalesce(first_value(CASE WHEN b <> -1 THEN b END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), e) ELSE e END AS DOUBLE) AS fixed_end FROM g""")
def gap_repair(spark, d):
    n = F.col("l_linenumber")
    g = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 5 == 0, -1.0).otherwise(n * 10.0).alias("b"), F.when(F.col("l_suppkey") % 4 == 0, -1.0).otherwise(n * 10.0 + 8).alias("e"))
    return ordered.repair_gaps(g, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "b", "e").select("l_orderkey", "l_linenumber", "fixed_begin", "fixed_end")


@query("SELECT o.o_orderkey, n.n_nationkey FROM (SELECT o_orderkey, o_orderkey % 5 AS r, o_orderkey % 25 AS v FROM orders) o JOIN nation n ON n.n_regionkey = o.r AND o.v BETWEEN n.n_nationkey - 3 AND n.n_nationkey + 3")
def verse_range_join(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("r"), (F.col("o_orderkey") % 25).alias("v"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r"), (F.col("n_nationkey") - 3).alias("lo"), (F.col("n_nationkey") + 3).alias("hi"))
    return joins.range_join(o, n, "r", "v", "lo", "hi").select("o_orderkey", "n_nationkey")
