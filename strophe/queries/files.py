"""File names, books, references and the choice of files and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.functions import text as tx
from strophe.operators import language, media
from strophe.queries.catalog import TREE, tree
from strophe.queries.views import table
from strophe.registry import query

V2 = "v2 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0') || '__' || lpad(CAST(o_orderkey % 150 AS VARCHAR), 3, '_') || '_' || rpad(CASE o_orderkey % 3 WHEN 0 THEN 'Psalms' WHEN 1 THEN 'John' ELSE '1Kings' END, 12, '_') || 'ENGKJVO1DA.mp3' AS name FROM orders)"


def v2_names(spark, d):
    k = F.col("o_orderkey")
    book = F.when(k % 3 == 0, "Psalms").when(k % 3 == 1, "John").otherwise("1Kings")
    name = F.concat(F.when(k % 2 == 0, "A").otherwise("B"), F.lpad((k % 40).cast("string"), 2, "0"), F.lit("__"), F.lpad((k % 150).cast("string"), 3, "_"), F.lit("_"), F.rpad(book, 12, "_"), F.lit("ENGKJVO1DA.mp3"))
    return table(spark, d, "orders").select(k, name.alias("name"))


@query(f"""WITH {V2} SELECT o_orderkey, CASE name[1] WHEN 'A' THEN 'OT' ELSE 'NT' END AS testament, trim(name[2:4], '_') AS book_seq, CAST(trim(name[6:8], '_') AS INT) AS chapter, trim(name[10:21], '_') AS book_name, 'ENGKJVO1DA' AS media_id FROM v2""")
def file_names_v2(spark, d):
    return v2_names(spark, d).select("o_orderkey", *[c.alias(n) for n, c in tx.v2_name(F.col("name")).items()])


@query(f"""WITH {V2}, codes AS (SELECT * FROM (VALUES ('Psalms', 'PSA'), ('John', 'JHN')) t(book_name, code)) SELECT o_orderkey, coalesce(code, '') AS book_id FROM v2 LEFT JOIN codes ON book_name = trim(name[10:21], '_')""")
def book_codes(spark, d):
    codes = spark.createDataFrame([("Psalms", "PSA"), ("John", "JHN")], "book_name string, code string")
    names = v2_names(spark, d).select("o_orderkey", tx.v2_name(F.col("name"))["book_name"].alias("book_name"))
    return names.join(F.broadcast(codes), "book_name", "left").select("o_orderkey", F.coalesce("code", F.lit("")).alias("book_id"))


@query("""WITH n AS (SELECT p_partkey AS k FROM part) SELECT k, 'ENGKJVO1DA' AS media_id, CASE WHEN k % 5 = 0 THEN '' WHEN k % 2 = 0 THEN 'OT' ELSE 'NT' END AS testament, CASE WHEN k % 5 = 0 THEN '' ELSE '01' END AS book_seq,
CASE WHEN k % 5 < 2 THEN '' ELSE 'MAT' END AS book_id, CASE WHEN k % 5 < 3 THEN 0 ELSE CAST(k % 28 AS INT) END AS chapter, CASE WHEN k % 5 < 4 THEN '' ELSE '2' END AS verse, CASE WHEN k % 5 < 4 THEN 0 ELSE 6 END AS chapter_end, CASE WHEN k % 5 < 4 THEN '' ELSE '3' END AS verse_end FROM n""")
def file_names_v4(spark, d):
    k = F.col("p_partkey")
    parts = [F.lit("ENGKJVO1DA"), F.concat(F.when(k % 2 == 0, "A").otherwise("B"), F.lit("01")), F.lit("MAT"), (k % 28).cast("string")]
    name = F.when(k % 5 == 4, F.concat(F.concat_ws("_", *parts), F.lit("_2-6_3"))).otherwise(F.array_join(F.slice(F.array(*parts), 1, (k % 5 + 1).cast("int")), "_"))
    named = table(spark, d, "part").select(k.alias("k"), F.concat(name, F.lit(".mp3")).alias("name"))
    return named.select("k", *[c.alias(n) for n, c in tx.v4_audio_name(F.col("name")).items()])


@query("""WITH n AS (SELECT p_partkey AS k, substr('NOP', CAST(p_partkey % 3 + 1 AS INT), 1) || '2' AS drama, CASE p_partkey % 2 WHEN 0 THEN 'PSA' ELSE 'JHN' END AS book FROM part)
SELECT k, CASE WHEN k % 7 <> 0 THEN CASE k % 3 WHEN 0 THEN 'NT' WHEN 1 THEN 'OT' ELSE CASE k % 2 WHEN 0 THEN 'OT' ELSE 'NT' END END END AS testament, CASE WHEN k % 7 <> 0 THEN '019' END AS book_seq, CASE WHEN k % 7 <> 0 THEN book END AS book_id,
CASE WHEN k % 7 <> 0 THEN CAST(k % 21 AS INT) END AS chapter, CASE WHEN k % 7 <> 0 THEN 'ENGKJV' || drama || 'DA' END AS media_id FROM n""")
def file_names_vox(spark, d):
    k = F.col("p_partkey")
    drama = F.concat(F.substr(F.lit("NOP"), (k % 3 + 1).cast("int"), F.lit(1)), F.lit("2"))
    name = F.concat_ws("_", drama, F.lit("ENG"), F.lit("KJV"), F.lit("019"), F.when(k % 2 == 0, "PSA").otherwise("JHN"), k % 21, F.when(k % 7 != 0, "vox.wav").otherwise("vox_2.wav"))
    named = table(spark, d, "part").select(k.alias("k"), name.alias("name"))
    return named.select("k", *[c.alias(n) for n, c in tx.vox_name(F.col("name")).items()])


@query("""WITH f AS (SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'NT' ELSE 'OT' END AS t, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'GEN' WHEN 2 THEN 'MAT' WHEN 3 THEN 'PSA' ELSE 'REV' END AS book FROM orders)
SELECT o_orderkey, book FROM f WHERE book = '' OR t = 'NT' OR (t = 'OT' AND book IN ('PSA', 'GEN'))""")
def requested_books(spark, d):
    k = F.col("o_orderkey")
    book = F.when(k % 5 == 0, "").when(k % 5 == 1, "GEN").when(k % 5 == 2, "MAT").when(k % 5 == 3, "PSA").otherwise("REV")
    f = table(spark, d, "orders").select(k, F.when(k % 2 == 0, "NT").otherwise("OT").alias("t"), book.alias("book"))
    return f.filter(tx.requested(F.col("t"), F.col("book"), ot=["PSA", "GEN"], nt=True)).select("o_orderkey", "book")


@query("""WITH f AS (SELECT p_brand, p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'audio_drama' ELSE 'audio_stream' END AS type, CASE p_size % 3 WHEN 0 THEN 'mp' WHEN 1 THEN 'MP3' ELSE 'opus' END AS codec,
  CASE p_size % 2 WHEN 0 THEN '3kbps' ELSE '64kbps' END AS bitrate, CASE p_partkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'NT' WHEN 2 THEN 'OT' ELSE 'S' END AS size FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE type WHEN 'audio_stream' THEN 1 WHEN 'audio' THEN 2 ELSE 3 END, p_partkey) AS i FROM f WHERE codec <> 'opus' AND size IN ('C', 'NT'))
SELECT p_brand, p_partkey, type, 'MP3' AS codec, '64kbps' AS bitrate, size FROM r WHERE i = 1""")
def media_choice(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 3 == 0, "audio").when(k % 3 == 1, "audio_drama").otherwise("audio_stream")
    codec = F.when(n % 3 == 0, "mp").when(n % 3 == 1, "MP3").otherwise("opus")
    size = F.when(k % 4 == 0, "C").when(k % 4 == 1, "NT").when(k % 4 == 2, "OT").otherwise("S")
    f = table(spark, d, "part").select("p_brand", k, kind.alias("type"), codec.alias("codec"), F.when(n % 2 == 0, "3kbps").otherwise("64kbps").alias("bitrate"), size.alias("size"))
    return media.pick_audio(f, ["p_brand"], "NT", "MP3", "64kbps", "p_partkey", preferred="audio_stream")


@query("WITH f AS (SELECT DISTINCT 'ENGKJVO1DA' || CASE p_size % 3 WHEN 0 THEN '16' WHEN 1 THEN '' ELSE '-opus32' END AS fileset, p_brand FROM part) SELECT CASE WHEN length(fileset) = 10 THEN '64' ELSE substr(fileset, 11) END AS bitrate, max({'fileset': fileset, 'brand': p_brand}) AS chosen FROM f GROUP BY ALL")
def bitrate_map(spark, d):
    n = F.col("p_size")
    f = table(spark, d, "part").select(F.concat(F.lit("ENGKJVO1DA"), F.when(n % 3 == 0, "16").when(n % 3 == 1, "").otherwise("-opus32")).alias("fileset"), "p_brand").distinct()
    return f.groupBy(tx.bitrate_of(F.col("fileset")).alias("bitrate")).agg(F.max(F.struct("fileset", F.col("p_brand").alias("brand"))).alias("chosen"))


LANGUAGES = "l AS (SELECT n_nationkey, upper(substr(n_name, 1, 3)) AS iso3, lower(substr(n_name, 1, 2)) AS iso1 FROM nation), t AS (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN upper(substr(n_name, 1, 3)) ELSE lower(substr(n_name, 1, 2)) END AS iso FROM nation WHERE n_nationkey % 3 < 2), c AS (SELECT n_nationkey, iso3, iso1, CASE WHEN iso3 IN (SELECT iso FROM t) THEN iso3 WHEN iso1 IN (SELECT iso FROM t) THEN iso1 ELSE '' END AS asr FROM l)"


def languages(spark, d):
    n = table(spark, d, "nation")
    three, one = F.upper(F.substring("n_name", 1, 3)), F.lower(F.substring("n_name", 1, 2))
    tool = n.filter("n_nationkey % 3 < 2").select(F.when(F.col("n_nationkey") % 3 == 0, three).otherwise(one).alias("iso"))
    return language.tool_codes(n.select("n_nationkey", three.alias("iso3"), one.alias("iso1")), tool, "asr")


@query(f"WITH {LANGUAGES} SELECT n_nationkey, iso3, iso1, asr FROM c")
def tool_codes(spark, d):
    return languages(spark, d)


@query(f"WITH {LANGUAGES} SELECT count(*) FILTER (asr <> '') AS n, round(100.0 * count(*) FILTER (asr <> '') / count(*), 6) AS percent FROM c")
def tool_coverage(spark, d):
    has = F.count_if(F.col("asr") != "")
    return languages(spark, d).agg(has.alias("n"), F.round(100.0 * has / F.count("*"), 6).alias("percent"))


#: The climb by its own rule: the limit is carried from ancestor to ancestor.
SEARCH = f"""{TREE}, good AS (SELECT id FROM tree WHERE id % 10 = 3), s AS (SELECT u.id, u.up, u.ancestor, h.height, g.down FROM up u
JOIN (SELECT ancestor, max(up) AS height FROM up GROUP BY ancestor) h ON h.ancestor = u.ancestor LEFT JOIN (SELECT ancestor, min(up) AS down FROM up WHERE id IN (SELECT id FROM good) GROUP BY ancestor) g ON g.ancestor = u.ancestor),
climb AS (SELECT id, up, CASE WHEN down <= 1000 THEN down ELSE least(height, 1000) END AS looked, CASE WHEN down <= 1000 THEN down - 1 ELSE 1000 END AS lim, CASE WHEN down <= 1000 THEN ancestor END AS spot, CASE WHEN down <= 1000 THEN down END AS level FROM s WHERE up = 0
  UNION ALL SELECT s.id, s.up, CASE WHEN s.down <= c.lim THEN s.down ELSE least(s.height, c.lim) END, CASE WHEN s.down <= c.lim THEN s.down - 1 ELSE c.lim END, CASE WHEN s.down <= c.lim THEN s.ancestor ELSE c.spot END, CASE WHEN s.down <= c.lim THEN s.down ELSE c.level END
  FROM climb c JOIN s ON s.id = c.id AND s.up = c.up + 1 WHERE c.lim > 0),
last AS (SELECT id, arg_max(up + looked, up) AS distance, arg_max({{'spot': spot, 'level': level}}, up) AS hit FROM climb GROUP BY id),
found AS (SELECT l.id, coalesce((SELECT list(u.id ORDER BY u.id) FROM up u WHERE u.ancestor = l.hit.spot AND u.up = l.hit.level AND u.id IN (SELECT id FROM good)), []) AS found, distance FROM last l)"""


@query(f"WITH RECURSIVE {SEARCH} SELECT id, found, distance FROM found")
def tree_search(spark, d):
    return language.tree_search(tree(spark, d), "id % 10 = 3")


@query(f"WITH RECURSIVE {SEARCH} SELECT id, CASE WHEN id % 4 = 0 THEN 'own' ELSE CAST(found[1] AS VARCHAR) END AS language FROM found")
def language_choice(spark, d):
    searched = language.tree_search(tree(spark, d), "id % 10 = 3")
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, "own").otherwise("").alias("override"))
    return language.choose(requests, searched).select("id", "language")


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'GEN' WHEN 1 THEN 'GEN ' || p_size WHEN 2 THEN 'GEN ' || p_size || ':3' WHEN 3 THEN 'GEN ' || p_size || ':3-7' ELSE 'GEN ' || p_size || ':3-' || (p_size + 1) || ':2' END AS ref FROM part)
SELECT p_partkey, ref, 'GEN' AS book_id, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS chapter, CASE WHEN p_partkey % 5 < 2 THEN '' ELSE '3' END AS verse, CASE WHEN p_partkey % 5 = 4 THEN p_size + 1 ELSE 0 END AS chapter_end, CASE p_partkey % 5 WHEN 3 THEN '7' WHEN 4 THEN '2' ELSE '' END AS verse_end FROM r JOIN part USING (p_partkey)""")
def parsed_refs(spark, d):
    k, c = F.col("p_partkey"), F.concat(F.lit("GEN "), F.col("p_size").cast("string"))
    range_ = F.concat(c, F.lit(":3-"), (F.col("p_size") + 1).cast("string"), F.lit(":2"))
    ref = F.when(k % 5 == 0, "GEN").when(k % 5 == 1, c).when(k % 5 == 2, F.concat(c, F.lit(":3"))).when(k % 5 == 3, F.concat(c, F.lit(":3-7"))).otherwise(range_)
    return table(spark, d, "part").select(k, ref.alias("ref")).select("p_partkey", "ref", *[x.alias(n) for n, x in tx.parse_reference(F.col("ref")).items()])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'unknown-dataset' ELSE c_name END AS dataset FROM customer")
def yaml_values(spark, d):
    k = F.col("c_custkey")
    yaml = F.when(k % 3 == 0, F.concat(F.lit("is_new: no\nbible: "), "c_name")).otherwise(F.concat(F.lit("is_new: no\ndataset:  "), "c_name", F.lit(" \nbible: x")))
    return table(spark, d, "customer").select(k, tx.yaml_value(yaml, "dataset").alias("dataset"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'N' || (p_partkey % 10) || 'ENGESV' END AS fileset FROM part")
def fileset_ids(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "no id here N2ENG").otherwise(F.concat(F.lit("row "), k.cast("string"), F.lit(" N"), (k % 10).cast("string"), F.lit("ENGESVDA, A1BCDEFGH")))
    return table(spark, d, "part").select(k, tx.fileset_id(text).alias("fileset"))
