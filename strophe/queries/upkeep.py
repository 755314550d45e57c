"""Tags, new keys, indexes, times and other upkeep of the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strophe.operators import joins
from strophe.queries.views import SCRIPTS, scripts, table
from strophe.registry import query


@query("""WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'fair' ELSE s_name END AS tag FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey + 1000000, 'new' FROM supplier WHERE s_suppkey <= 5)
SELECT coalesce(s.s_suppkey, c.s_suppkey) AS s_suppkey, coalesce(c.tag, s.s_name) AS tag, CASE WHEN s.s_suppkey IS NULL THEN 'insert' WHEN c.s_suppkey IS NOT NULL AND c.tag <> s.s_name THEN 'update' ELSE '' END AS action FROM supplier s FULL JOIN c ON s.s_suppkey = c.s_suppkey""")
def tag_upsert(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("tag"))
    changes = s.filter("s_suppkey % 3 = 0").withColumn("tag", F.when(F.col("s_suppkey") % 2 == 0, "fair").otherwise(F.col("tag")))
    new = s.filter("s_suppkey <= 5").select((F.col("s_suppkey") + 1_000_000).alias("s_suppkey"), F.lit("new").alias("tag"))
    return joins.upsert_if_changed(s, changes.unionByName(new), ["s_suppkey"], "tag")


@query("SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name) AS s_suppkey, n_name AS s_name FROM nation WHERE n_nationkey % 2 = 0")
def insert_new(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    rows = table(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, 0).otherwise(F.col("n_nationkey") + 1).cast("long").alias("s_suppkey"), F.col("n_name").alias("s_name"))
    return joins.insert_new(s, rows, "s_suppkey", ["s_name"])


@query("SELECT (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 0) + row_number() OVER (ORDER BY o_custkey, o_totalprice, o_orderdate) AS o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 2 = 1")
def insert_many(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    new = o.filter("o_orderkey % 2 = 1").withColumn("o_orderkey", F.lit(0).cast("long"))
    return joins.insert_new(o.filter("o_orderkey % 2 = 0"), new, "o_orderkey", ["o_custkey", "o_totalprice", "o_orderdate"])


@query("SELECT label, count(*) AS n, arg_min(vec_id, vec_id) AS first_id, max(vec_id) FILTER (i = 5) AS fifth FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings) GROUP BY label")
def point_by_index(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("i"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max(F.when(F.col("i") == 5, F.col("vec_id"))).alias("fifth"))


@query("SELECT doc_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS indexes, sum(i)::BIGINT AS total FROM (SELECT doc_id, unnest(range(doc_id % 5 + 1)) AS i FROM documents) GROUP BY doc_id")
def joined_indexes(spark, d):
    i = F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 5)
    joined = table(spark, d, "documents").select("doc_id", F.array_join(i.cast("array<string>"), ",").alias("indexes"))
    total = F.aggregate(F.split("indexes", ",").cast("array<bigint>"), F.lit(0).cast("long"), lambda a, x: a + x)
    return joined.select("doc_id", "indexes", total.alias("total"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def stamp_text(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("SELECT event_id FROM events WHERE (SELECT max(ts) FROM events) - ts > INTERVAL 3 DAY")
def old_objects(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).filter("now - ts > INTERVAL 3 DAYS").select("event_id")


@query("""WITH t AS (SELECT l_orderkey, sum(l_quantity) AS spoken FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, CASE WHEN abs(spoken - o_totalprice % 200) <= 1 THEN 'exact' WHEN abs(spoken - o_totalprice % 200) <= 2 THEN 'near' WHEN spoken IS NULL THEN 'missing' ELSE 'off' END AS status FROM orders LEFT JOIN t ON l_orderkey = o_orderkey""")
def runtime_check(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("spoken"))
    apart = F.abs(F.col("spoken") - F.col("o_totalprice") % 200)
    status = F.when(apart <= 1, "exact").when(apart <= 2, "near").when(F.col("spoken").isNull(), "missing").otherwise("off")
    return table(spark, d, "orders").join(t, "o_orderkey", "left").select("o_orderkey", status.alias("status"))


@query("SELECT 1 AS dataset_id, coalesce(max(source), '') AS source, coalesce(max(lang), '') AS lang FROM documents WHERE doc_id = -1")
def missing_ident(spark, d):
    """The dataset's description, empty strings where there is none."""
    found = table(spark, d, "documents").filter("doc_id = -1")
    return found.agg(F.lit(1).alias("dataset_id"), F.coalesce(F.max("source"), F.lit("")).alias("source"), F.coalesce(F.max("lang"), F.lit("")).alias("lang"))


@query(f"WITH {SCRIPTS} SELECT script_id, ltrim(lpad(CAST(verse_num AS VARCHAR), 5, '0'), '0') AS script_num FROM scripts")
def script_numbers(spark, d):
    return scripts(spark, d).select("script_id", F.ltrim(F.lpad(F.col("verse_num").cast("string"), 5, "0"), F.lit("0")).alias("script_num"))


@query("SELECT l_orderkey, list(coalesce(CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity END, 0.0) ORDER BY l_linenumber, l_partkey, l_suppkey) AS ends FROM lineitem GROUP BY l_orderkey")
def ends_without_null(spark, d):
    end = F.coalesce(F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity")), F.lit(0.0))
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", end.alias("e"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda r: r["e"]).alias("ends"))


@query("SELECT lang, source, count(*) AS n, list(doc_id ORDER BY n_chars, doc_id) AS by_length FROM documents GROUP BY lang, source")
def by_length(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("n_chars", "doc_id")))
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.transform(rows, lambda r: r["doc_id"]).alias("by_length"))


@query("SELECT vec_id, greatest(len(embedding), 100) AS n_values, greatest(len(embedding), 100) * 4 / 1048576.0 AS mb FROM embeddings")
def tensor_sizes(spark, d):
    n = F.greatest(F.size("embedding"), F.lit(100)).cast("long")
    return table(spark, d, "embeddings").select("vec_id", n.alias("n_values"), (n * 4 / 1048576.0).alias("mb"))
