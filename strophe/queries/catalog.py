"""Catalog joins, DML and the language tree; TPC-H tables stand for bibles, filesets, files and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.operators import joins, language, tree as forest
from strophe.queries.views import SCRIPTS, WORDS, scripts, table, words
from strophe.registry import query


@query(f"WITH {WORDS} SELECT w.script_id, w.word_seq, w.word, s.person FROM words w JOIN scripts s USING (script_id) WHERE w.ttype = 'W'")
def words_scripts(spark, d):
    return words(spark, d).filter("ttype = 'W'").join(scripts(spark, d).select("script_id", "person"), "script_id").select("script_id", "word_seq", "word", "person")


@query(f"""WITH {WORDS}, c AS (SELECT script_id, word_seq, unnest(string_split(word, '')) AS ch FROM words WHERE ttype = 'W') SELECT s.person, c.ch, count(*) AS n FROM c JOIN words w USING (script_id, word_seq) JOIN scripts s ON s.script_id = c.script_id GROUP BY s.person, c.ch""")
def chars_words_scripts(spark, d):
    w = words(spark, d).filter("ttype = 'W'").select("script_id", "word_seq", "word")
    chars = w.select("script_id", "word_seq", F.explode(F.split("word", "")).alias("ch")).filter("ch != ''")
    return chars.join(w, ["script_id", "word_seq"]).join(scripts(spark, d), "script_id").groupBy("person", "ch").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, 0) AS quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def lines_left_mfcc(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("hit"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(0)).alias("quality"), F.col("hit").isNull().alias("missing"))


SIDES = f"WITH {SCRIPTS}, b AS (SELECT chapter_num, verse_num // 2 AS pair, script_text FROM scripts WHERE person = 'user'), c AS (SELECT chapter_num, verse_num // 2 AS pair, script_text, script_id FROM scripts WHERE person <> 'user')"


@query(f"{SIDES}, cc AS (SELECT chapter_num, pair, arg_max(script_text, script_id) AS script_text FROM c GROUP BY chapter_num, pair) SELECT chapter_num, pair, coalesce(b.script_text, '') AS base_text, coalesce(cc.script_text, '') AS comp_text FROM b FULL JOIN cc USING (chapter_num, pair)")
def full_outer_compare(spark, d):
    s = scripts(spark, d).withColumn("pair", F.floor(F.col("verse_num") / 2))
    return joins.full_outer_compare(s.filter("person = 'user'"), s.filter("person != 'user'"), ["chapter_num", "pair"], "script_text", "script_id")


@query(f"{SIDES}, bb AS (SELECT chapter_num, pair, script_text FROM b) SELECT c.script_id, coalesce(bb.script_text, '') AS base_text, c.script_text AS comp_text FROM c LEFT JOIN bb USING (chapter_num, pair)")
def line_compare(spark, d):
    s = scripts(spark, d).withColumn("pair", F.floor(F.col("verse_num") / 2))
    base = s.filter("person = 'user'").select("chapter_num", "pair", F.col("script_text").alias("base_text"))
    comp = s.filter("person != 'user'")
    return comp.join(base, ["chapter_num", "pair"], "left").select("script_id", F.coalesce("base_text", F.lit("")).alias("base_text"), F.col("script_text").alias("comp_text"))


@query("""WITH s AS (SELECT l_orderkey, sum(l_quantity) AS duration FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey), t AS (SELECT l_orderkey, sum(l_quantity) AS duration FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 GROUP BY l_orderkey)
SELECT s.l_orderkey, CASE WHEN t.duration IS NULL THEN 'missing target duration' WHEN abs(s.duration - t.duration) <= 10 THEN 'match' ELSE 'duration mismatch' END AS status FROM s LEFT JOIN t USING (l_orderkey)""")
def duration_match(spark, d):
    li = table(spark, d, "lineitem")
    s = li.filter("l_linenumber <= 3").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("duration"))
    t = li.filter("l_linenumber between 2 and 4").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("duration"))
    return joins.duration_match(s, t, ["l_orderkey"], 10.0)


def star(spark, d) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("region", "nation", "customer", "orders", "lineitem", "supplier", "part")}
    return (
        t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    )


@query("""SELECT DISTINCT r_name, n_name, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus IN ('F', 'O') AND p_size < 20""")
def seven_way(spark, d):
    return star(spark, d).filter(F.col("o_orderstatus").isin("F", "O") & (F.col("p_size") < 20)).select("r_name", "n_name", "p_brand").distinct()


@query("""SELECT c_custkey, c_name, min(o_orderkey) AS first_order FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c_custkey AND x.o_orderpriority ILIKE '1-urgent%') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < -900) AND n_nationkey <> 3 GROUP BY c_custkey, c_name""")
def discovery(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    urgent = o.filter(F.col("o_orderpriority").ilike("1-urgent%")).select(F.col("o_custkey").alias("c_custkey"))
    poor = table(spark, d, "supplier").filter("s_acctbal < -900").select(F.col("s_nationkey").alias("c_nationkey"))
    nation = table(spark, d, "nation").filter("n_nationkey != 3").select(F.col("n_nationkey").alias("c_nationkey"))
    kept = c.join(urgent, "c_custkey", "left_anti").join(poor, "c_nationkey", "left_anti").join(nation, "c_nationkey")
    return kept.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey", "c_name").agg(F.min("o_orderkey").alias("first_order"))


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'")
def on_clause_left(spark, d):
    tags = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return table(spark, d, "orders").select("o_orderkey").join(tags, "o_orderkey", "left")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 200000)")
def not_in_anti(spark, d):
    rich = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(rich, "c_custkey", "left_anti")


@query("SELECT p.p_brand, substr(p.p_name, 1, 3) AS stem, count(*) AS n FROM part p JOIN (SELECT DISTINCT substr(p_name, 1, 3) AS stem FROM part WHERE p_size = 1) s ON substr(p.p_name, 1, 3) = s.stem GROUP BY 1, 2")
def prefix_key_join(spark, d):
    p = table(spark, d, "part").withColumn("stem", F.substring("p_name", 1, 3))
    return p.join(p.filter("p_size = 1").select("stem").distinct(), "stem").groupBy("p_brand", "stem").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM region) * (SELECT count(*) FROM nation) AS n")
def product_count(spark, d):
    # the product of two counts, without the product of the rows
    return table(spark, d, "region").agg(F.count("*").alias("a")).crossJoin(table(spark, d, "nation").agg(F.count("*").alias("b"))).select((F.col("a") * F.col("b")).alias("n"))


@query("SELECT DISTINCT o_orderkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def copy_timestamps(spark, d):
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return o.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey").dropDuplicates()


@query("SELECT n_name, count(*) AS n_timestamps, count(DISTINCT o_orderkey) AS n_files FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def timestamp_counts(spark, d):
    return star(spark, d).groupBy("n_name").agg(F.count("*").alias("n_timestamps"), F.count_distinct("o_orderkey").alias("n_files"))


@query("SELECT o_orderkey, list({'n': l_linenumber, 'q': l_quantity} ORDER BY l_linenumber, l_quantity) AS times FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def grouped_times(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    return table(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey").groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("n", "q"))).alias("times"))


@query("SELECT c_custkey, first_file, n FROM (SELECT c_custkey, min(o_orderkey) AS first_file FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) f JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) t ON t.l_orderkey = f.first_file")
def first_file_times(spark, d):
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_file"))
    times = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("first_file")).agg(F.count("*").alias("n"))
    return first.join(table(spark, d, "customer").select("c_custkey"), "c_custkey").join(times, "first_file").select("c_custkey", "first_file", "n")


@query("""WITH a AS (SELECT doc_id AS id, n_chars AS a FROM documents WHERE lang = 'en'), b AS (SELECT doc_id AS id, quality AS b FROM labels), c AS (SELECT item_id AS id, length(text) AS c FROM benchmark)
SELECT coalesce(a.id, b.id, c.id) AS id, a.a, b.b, c.c FROM a FULL JOIN b ON a.id = b.id FULL JOIN c ON c.id = coalesce(a.id, b.id)""")
def align_datasets(spark, d):
    a = table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("a"))
    b = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("b"))
    c = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("c"))
    return a.join(b, "id", "full_outer").join(c, "id", "full_outer")


@query("WITH u AS (SELECT s_suppkey, s_name, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 1000000, 'new', 0) SELECT s_suppkey, s_name, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM u) UNION ALL SELECT s_suppkey, s_name, CAST(s_acctbal AS DOUBLE) FROM u")
def upsert(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = spark.createDataFrame([(1_000_000, "new", 0.0)], s.schema)
    changes = s.filter("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1).unionByName(new)
    return joins.upsert(s, changes, ["s_suppkey"])


@query("SELECT o_orderkey, coalesce(t.total, o_totalprice) AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey) t ON t.l_orderkey = o_orderkey")
def keyed_update(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    t = table(spark, d, "lineitem").filter("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
    return joins.keyed_update(o, t, ["o_orderkey"], ["o_totalprice"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    _, left = joins.cascade_delete(o, table(spark, d, "lineitem"), "l_orderkey", o.filter("o_orderstatus = 'F'").select("l_orderkey"))
    return left.select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey + 1000000 AS p_partkey, p_name FROM part WHERE p_brand <> 'Brand#11' UNION ALL SELECT p_partkey, p_name FROM part")
def insert_select(spark, d):
    p = table(spark, d, "part")
    copies = p.filter("p_brand != 'Brand#11'").select((F.col("p_partkey") + 1_000_000).alias("p_partkey"), "p_name")
    return copies.unionByName(p.select("p_partkey", "p_name"))


def tree(spark, d) -> DataFrame:
    """A tree of the customers: each number's parent is a seventh of it."""
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(c.alias("id"), F.when(c > 7, F.floor(c / 7)).alias("parent_id"))


TREE = "tree AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 7 THEN c_custkey // 7 END AS parent_id FROM customer), up AS (SELECT id, id AS ancestor, 0::BIGINT AS up FROM tree UNION ALL SELECT u.id, t.parent_id, u.up + 1 FROM up u JOIN tree t ON t.id = u.ancestor WHERE t.parent_id IS NOT NULL)"


@query(f"WITH RECURSIVE {TREE} SELECT ancestor, up AS depth, count(*) AS n FROM up GROUP BY ancestor, up")
def tree_descendants(spark, d):
    return language.ancestors(tree(spark, d)).groupBy("ancestor", F.col("up").alias("depth")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE tree AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 7 THEN c_custkey // 7 END AS parent_id FROM customer),
w AS (SELECT id, [id] AS path FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, list_append(w.path, t.id) FROM w JOIN tree t ON t.parent_id = w.id),
r AS (SELECT id, path, len(path) - 1 AS depth, row_number() OVER (ORDER BY path) - 1 AS pre FROM w), s AS (SELECT a AS id, count(*) AS size, count(*) FILTER (id % 10 = 3) AS supported FROM (SELECT id, unnest(path) AS a FROM w) GROUP BY a)
SELECT r.id, 2 * pre - depth AS enter, 2 * pre - depth + 2 * size - 1 AS "exit", depth, supported FROM r JOIN s ON s.id = r.id""")
def tree_index(spark, d):
    return forest.index(tree(spark, d), {"supported": F.col("id") % 10 == 3})


@query(f"""WITH RECURSIVE {TREE}, m AS (SELECT a.id, a.up, b.up AS down, b.id AS found FROM up a JOIN up b ON a.ancestor = b.ancestor WHERE b.id % 10 = 3)
SELECT id, found, distance FROM (SELECT id, found, up + down AS distance, row_number() OVER (PARTITION BY id ORDER BY up + down, up, found) AS i FROM m) WHERE i = 1""")
def tree_nearest(spark, d):
    return language.nearest_supported(tree(spark, d), "id % 10 = 3")
