"""Verse marks, keys and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strophe.functions import rewrite, text as tx
from strophe.operators import ordered
from strophe.queries.views import TIMELINE, table, timeline
from strophe.registry import query

MARK = r"(\{[0-9]+\}(?:_\{[0-9]+\})*)([^{]*)"


@query(f"""WITH m AS (SELECT item_id, '{{' || item_id || '}} ' || text || ' {{' || (item_id + 1) || '}}_{{' || (item_id + 2) || '}} amen' AS t FROM benchmark),
p AS (SELECT item_id, unnest(regexp_extract_all(t, '{MARK}', 1)) AS m, unnest(regexp_extract_all(t, '{MARK}', 2)) AS x FROM m)
SELECT item_id, CASE WHEN contains(m, '_') THEN regexp_extract(m, '^\\{{([0-9]+)', 1) || '-' || regexp_extract(m, '([0-9]+)\\}}$', 1) ELSE regexp_extract(m, '([0-9]+)', 1) END AS verse, trim(x) AS text FROM p""")
def verse_split(spark, d):
    i = F.col("item_id")
    marked = F.concat(F.lit("{"), i, F.lit("} "), F.col("text"), F.lit(" {"), i + 1, F.lit("}_{"), i + 2, F.lit("} amen"))
    return table(spark, d, "benchmark").select("item_id", F.inline(tx.verses(marked)))


@query()
def rewritten_text(spark, d):
    """Documents by the rules of four languages in turn; no SQL (NFKC), tests apply rule by rule."""
    code = F.element_at(F.array(*map(F.lit, ("eng", "ara", "heb", "mon"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", code.alias("language"), rewrite.normalize_text("text", code).alias("normal"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(lower(text), '\([^()]*[0-9][^()]*\)', ' ', 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(t, '[^\p{L}\p{N}\p{M}'' ]+', ' ', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(' ' || regexp_replace(t, ' +', '  ', 'g') || ' ', ' [0-9]+ ', ' ', 'g') AS t FROM b) SELECT doc_id, md5(trim(regexp_replace(t, ' +', ' ', 'g'))) AS norm_md5 FROM c""")
def alignment_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.normalize_for_alignment(F.col("text"))).alias("norm_md5"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 3 AS VARCHAR) AS verse FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, verse ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM v)
SELECT l_orderkey, l_linenumber, CASE WHEN verse = '0' AND n = 2 THEN '0s' ELSE verse END AS verse_key, n > 1 AND NOT (verse = '0' AND n = 2) AS is_error FROM n""")
def repeated_verses(spark, d):
    v = table(spark, d, "lineitem").withColumn("verse", (F.col("l_partkey") % 3).cast("string"))
    return ordered.number_repeated_keys(v, ["l_orderkey"], "verse", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "verse_key", "is_error")


@query(f"WITH {TIMELINE}, s AS (SELECT char_id, lead(begin_ts) OVER w - begin_ts AS duration, lead(char_id * 7) OVER w - char_id * 7 AS n_bytes FROM timeline WINDOW w AS (PARTITION BY file_id ORDER BY begin_ts, char_id)) SELECT char_id, round(duration, 6) AS duration, n_bytes FROM s WHERE duration IS NOT NULL")
def stream_segments(spark, d):
    t = timeline(spark, d).withColumn("offset", F.col("char_id") * 7)
    return ordered.segments_between(t, "file_id", ["begin_ts", "char_id"], "begin_ts", "offset").select("char_id", F.round("duration", 6).alias("duration"), "n_bytes")


@query("SELECT o_custkey, lpad(CAST(max(o_orderkey % 1000) + 1 AS VARCHAR), 5, '0') AS next_run FROM orders GROUP BY o_custkey")
def next_run(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.lpad((F.max(F.col("o_orderkey") % 1000) + 1).cast("string"), 5, "0").alias("next_run"))


@query("SELECT o_orderpriority, c, count(*) AS n FROM (SELECT o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'N' WHEN 2 THEN 'O' ELSE '' END AS c FROM orders) GROUP BY o_orderpriority, c")
def size_codes(spark, d):
    k = F.col("o_orderkey") % 4
    code = F.when(k == 0, "complete").when(k == 1, "NTP").when(k == 2, "ot").otherwise("S")
    return table(spark, d, "orders").groupBy("o_orderpriority", tx.size_code(code).alias("c")).agg(F.count("*").alias("n"))


@query("WITH v AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE CAST(p_partkey % 100 AS VARCHAR) END AS verse FROM part) SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY coalesce(TRY_CAST(verse AS INT), 0), p_partkey) AS place FROM v")
def numeric_order(spark, d):
    verse = F.when(F.col("p_partkey") % 4 == 0, "x").otherwise((F.col("p_partkey") % 100).cast("string"))
    w = Window.partitionBy("p_size").orderBy(F.coalesce(verse.try_cast("int"), F.lit(0)), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(w).cast("long").alias("place"))
