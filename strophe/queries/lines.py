"""Point reads, projections, sorts and set operations over script lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions import numbers as nx
from strophe.operators import joins
from strophe.operators.numbering import number
from strophe.queries.views import SCRIPTS, TIMELINE, WORDS, scripts, table, timeline, words
from strophe.registry import query


@query(f"WITH {WORDS} SELECT (SELECT count(*) FROM scripts) AS n_scripts, count(*) AS n_words, count(*) FILTER (ttype = 'W') AS n_w, count(DISTINCT script_id) AS n_used FROM words")
def table_counts(spark, d):
    w = words(spark, d).agg(F.count("*").alias("n_words"), F.count_if(F.col("ttype") == "W").alias("n_w"), F.count_distinct("script_id").alias("n_used"))
    return scripts(spark, d).agg(F.count("*").alias("n_scripts")).crossJoin(w)


@query(f"WITH {SCRIPTS} SELECT chapter_num, min(script_id) AS first_id FROM scripts GROUP BY chapter_num")
def first_appearance(spark, d):
    return scripts(spark, d).groupBy("chapter_num").agg(F.min("script_id").alias("first_id")).orderBy("first_id")


@query("SELECT DISTINCT source, lang FROM documents WHERE source <> ''")
def distinct_sources(spark, d):
    return table(spark, d, "documents").filter("source != ''").select("source", "lang").distinct()


@query(f"WITH {SCRIPTS} SELECT chapter_num, list({{'id': script_id, 'text': script_text}} ORDER BY script_id) AS lines FROM scripts GROUP BY chapter_num")
def chapter_lines(spark, d):
    line = F.struct(F.col("script_id").alias("id"), F.col("script_text").alias("text"))
    return scripts(spark, d).groupBy("chapter_num").agg(F.sort_array(F.collect_list(line)).alias("lines"))


@query(f"WITH {SCRIPTS} SELECT script_id, script_text FROM scripts WHERE person IN ('system', 'assistant')")
def headings_in_list(spark, d):
    return scripts(spark, d).filter(F.col("person").isin("system", "assistant")).select("script_id", "script_text")


@query("SELECT b.item_id, coalesce(d.text, '') AS script_text FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 37")
def point_lookups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    b = table(spark, d, "benchmark").select("item_id", (F.col("item_id") * 37).alias("doc_id"))
    return b.join(docs, "doc_id", "left").select("item_id", F.coalesce("text", F.lit("")).alias("script_text"))


@query("""WITH r AS (SELECT l_orderkey, 'GEN ' || (l_orderkey % 50) || ':' || (l_partkey % 30) || ' ' || l_linenumber AS ref, l_comment_len FROM (SELECT *, length(l_returnflag) AS l_comment_len FROM lineitem)),
p AS (SELECT CAST(split_part(split_part(ref, ':', 2), ' ', 1) AS BIGINT) AS verse, CAST(split_part(split_part(ref, ':', 2), ' ', 2) AS BIGINT) AS word, l_orderkey FROM r WHERE starts_with(ref, 'GEN 1:'))
SELECT verse, word, l_orderkey, row_number() OVER (PARTITION BY verse ORDER BY word, l_orderkey) AS place FROM p""")
def prefix_scan(spark, d):
    li = table(spark, d, "lineitem")
    ref = F.concat(F.lit("GEN "), F.col("l_orderkey") % 50, F.lit(":"), F.col("l_partkey") % 30, F.lit(" "), "l_linenumber")
    at = F.split(F.split("ref", ":")[1], " ")
    p = li.select("l_orderkey", ref.alias("ref")).filter(F.col("ref").startswith("GEN 1:")).select(at[0].cast("long").alias("verse"), at[1].cast("long").alias("word"), "l_orderkey")
    return number(p, ["word", "l_orderkey"], "place", keys=["verse"])


@query("SELECT max(o_totalprice <> 0) AS o_totalprice, max(o_shippriority <> 0) AS o_shippriority, max(o_orderpriority <> '') AS o_orderpriority FROM (SELECT *, 0 AS o_shippriority FROM orders)")
def active_columns(spark, d):
    o = table(spark, d, "orders").withColumn("o_shippriority", F.lit(0))
    return o.agg(F.max(F.col("o_totalprice") != 0).alias("o_totalprice"), F.max(F.col("o_shippriority") != 0).alias("o_shippriority"), F.max(F.col("o_orderpriority") != "").alias("o_orderpriority"))


@query(f"WITH {TIMELINE} SELECT file_id, char_id, 'verse_' || file_id || '_' || char_id AS segment FROM timeline WHERE NOT (begin_ts = 0 AND end_ts = 0)")
def named_segments(spark, d):
    t = timeline(spark, d).filter("not (begin_ts = 0 and end_ts = 0)")
    return t.select("file_id", "char_id", F.format_string("verse_%d_%d", "file_id", "char_id").alias("segment"))


@query("SELECT vec_id, list_filter(embedding, lambda x: x > 0.2) AS kept FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.2)) > 0")
def nested_prune(spark, d):
    kept = F.filter("embedding", lambda x: x > 0.2)
    return table(spark, d, "embeddings").select("vec_id", kept.alias("kept")).filter(F.size("kept") > 0)


@query("SELECT class, count(*) AS n FROM (SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'text' WHEN b THEN 'audio' ELSE 'neither' END AS class FROM (SELECT c_custkey % 2 = 0 AS a, c_acctbal > 0 AS b FROM customer)) GROUP BY class")
def availability(spark, d):
    a, b = F.col("c_custkey") % 2 == 0, F.col("c_acctbal") > 0
    kind = F.when(a & b, "both").when(a, "text").when(b, "audio").otherwise("neither")
    return table(spark, d, "customer").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("SELECT part AS source, id FROM (SELECT 'OT' AS part, c_custkey AS id FROM customer UNION ALL SELECT 'NT', s_suppkey FROM supplier)")
def union_inputs(spark, d):
    a = table(spark, d, "customer").select(F.lit("OT").alias("source"), F.col("c_custkey").alias("id"))
    return a.unionByName(table(spark, d, "supplier").select(F.lit("NT").alias("source"), F.col("s_suppkey").alias("id")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def set_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 16")
def topk_differences(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(16)


@query("SELECT o_custkey, min(o_orderdate) AS oldest, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS oldest_key FROM orders GROUP BY o_custkey")
def oldest_object(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("oldest"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("oldest_key"))


@query("""WITH k AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, CASE c_custkey % 4 WHEN 0 THEN 'audio' WHEN 1 THEN 'audio_drama' WHEN 2 THEN 'text' ELSE 'video' END AS kind FROM customer),
r AS (SELECT *, CASE kind WHEN 'text' THEN 1 WHEN 'audio' THEN 2 WHEN 'audio_drama' THEN 3 END AS p FROM k)
SELECT c_nationkey, c_custkey, kind FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) AS n FROM r WHERE p IS NOT NULL) WHERE n = 1""")
def priority_pick(spark, d):
    k = F.col("c_custkey") % 4
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.when(k == 0, "audio").when(k == 1, "audio_drama").when(k == 2, "text").otherwise("video").alias("kind"))
    return joins.priority_pick(c, ["c_nationkey"], "kind", ["text", "audio", "audio_drama"], "c_custkey")


@query("SELECT vec_id, list_slice(embedding, CAST(floor(0.1 * 50 + 0.5) AS INT) + 1, CAST(floor(0.5 * 50 + 0.5) AS INT)) AS part FROM embeddings")
def frame_slice(spark, d):
    return table(spark, d, "embeddings").select("vec_id", nx.frame_slice(F.col("embedding"), F.lit(0.1), F.lit(0.5), 50.0).alias("part"))


@query("SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [0.0::DOUBLE, 0.0::DOUBLE]) AS padded FROM embeddings")
def pad_rows(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    longest = e.agg((F.max(F.size("v")) + 2).alias("n"))
    return e.crossJoin(F.broadcast(longest)).select("vec_id", nx.pad_to(F.col("v"), F.col("n")).alias("padded"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, CASE WHEN value >= 60 THEN CAST(floor(value / 60) AS BIGINT) || ':' || printf('%.3f', value - 60 * floor(value / 60)) ELSE printf('%.3f', value) END AS clock FROM events")
def clock_text(spark, d):
    return table(spark, d, "events").select("event_id", nx.clock(F.col("value")).alias("clock"))
