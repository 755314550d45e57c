"""Tokens, vocabulary and text normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.functions import text as tx
from strophe.operators import training
from strophe.queries.views import SCRIPTS, SQL_TTYPE, WORDS, scripts, sql_tokens, table, words
from strophe.registry import query

DOC_TOKENS = f"tok AS (SELECT lang, unnest({sql_tokens('text')}) AS word FROM documents), typed AS (SELECT lang, word, {SQL_TTYPE} AS ttype FROM tok)"


def distinct_tokens(docs: DataFrame, *by: str) -> DataFrame:
    """by, word, n: the different tokens of the texts with their counts."""
    return docs.select(*by, F.explode(tx.tokens(F.col("text"))).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))


@query(f"WITH {DOC_TOKENS} SELECT lang, ttype, count(*) AS n_tokens, count(DISTINCT word) AS n_distinct FROM typed GROUP BY lang, ttype")
def token_counts(spark, d):
    # classified once for each different token, after the map-side counts
    t = distinct_tokens(table(spark, d, "documents"), "lang").withColumn("ttype", tx.token_type(F.col("word")))
    return t.groupBy("lang", "ttype").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"))


@query(f"WITH {DOC_TOKENS} SELECT lang, lower(word) AS word, count(*) AS n FROM typed WHERE ttype = 'W' GROUP BY lang, lower(word) HAVING count(*) > 1")
def word_vocab(spark, d):
    t = distinct_tokens(table(spark, d, "documents"), "lang").filter(tx.token_type(F.col("word")) == "W")
    return t.groupBy("lang", F.lower("word").alias("word")).agg(F.sum("n").alias("n")).filter("n > 1")


@query("""WITH chars AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]')) AS ch FROM documents)
SELECT ch AS token, row_number() OVER (ORDER BY ch) AS id FROM chars UNION ALL SELECT '|', 0
UNION ALL SELECT '[UNK]', (SELECT count(*) FROM chars) + 1 UNION ALL SELECT '[PAD]', (SELECT count(*) FROM chars) + 2""")
def token_index(spark, d):
    return training.token_index(table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z])"), F.lit(1))).alias("ch")))


@query(r"WITH c AS (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS ch FROM documents) SELECT ch, CAST(unicode(ch) AS BIGINT) AS code_point, count(*) AS n FROM c GROUP BY ch")
def char_freq(spark, d):
    c = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([^\x00-\x7F])"), F.lit(1))).alias("ch"))
    # four bytes, most significant first
    raw = F.conv(F.hex(F.encode("ch", "UTF-32")), 16, 10).cast("long")
    return c.groupBy("ch").agg(F.count("*").alias("n")).select("ch", raw.alias("code_point"), "n")


@query(r"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\x{0000}-\x{024F}]', '', 'g')) / CAST(length(text) AS DOUBLE) END, 9) AS latin, coalesce(length(text) > 0 AND length(regexp_replace(text, '[^\x{0000}-\x{024F}]', '', 'g')) / CAST(length(text) AS DOUBLE) > 0.9, false) AS is_latin FROM documents")
def latin_ratio(spark, d):
    r = tx.latin_ratio(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.round(r, 9).alias("latin"), F.coalesce(r > 0.9, F.lit(False)).alias("is_latin"))


@query(f"WITH {SCRIPTS} SELECT chapter_num, string_agg(script_text, ' ' ORDER BY script_id) AS chapter_text FROM scripts GROUP BY chapter_num")
def chapter_text(spark, d):
    parts = F.sort_array(F.collect_list(F.struct("script_id", "script_text")))
    return scripts(spark, d).groupBy("chapter_num").agg(F.array_join(F.transform(parts, lambda s: s["script_text"]), " ").alias("chapter_text"))


@query(f"""WITH {WORDS}, w AS (SELECT DISTINCT lower(word) AS word FROM words WHERE ttype = 'W')
SELECT word, word || ' ' || array_to_string(list_transform(string_split(word, ''), lambda x: CASE WHEN x = '-' THEN '|' ELSE x END), ' ') || ' |' AS spelling FROM w""")
def lexicon(spark, d):
    w = words(spark, d).filter("ttype = 'W'").select(F.lower("word").alias("word")).distinct()
    return w.select("word", tx.spelling(F.col("word")).alias("spelling"))


@query(f"WITH {WORDS} SELECT script_id, lower(string_agg(word, ' ' ORDER BY word_seq)) AS line FROM words WHERE ttype = 'W' GROUP BY script_id")
def script_lines(spark, d):
    parts = F.sort_array(F.collect_list(F.struct("word_seq", "word")))
    return words(spark, d).filter("ttype = 'W'").groupBy("script_id").agg(F.lower(F.array_join(F.transform(parts, lambda s: s["word"]), " ")).alias("line"))


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 || '-' || (o_orderkey % 50 + 4) ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS verse FROM orders)
SELECT o_orderkey, split_part(verse, '-', 1) AS verse_str, list_extract(string_split(verse, '-'), -1) AS verse_end FROM v""")
def verse_range_split(spark, d):
    o, n = table(spark, d, "orders"), F.col("o_orderkey") % 50
    verse = F.when(F.col("o_orderkey") % 3 == 0, F.concat(n, F.lit("-"), n + 4)).otherwise(n.cast("string"))
    first, last = tx.verse_range(verse)
    return o.select("o_orderkey", first.alias("verse_str"), last.alias("verse_end"))


@query("""SELECT l_orderkey, l_linenumber, 'B' || l_suppkey || ' ' || l_linenumber || ':' || (l_partkey % 7) ||
  CASE WHEN l_orderkey % 2 = 0 THEN '-' || (l_linenumber + 1) || ':' || (l_partkey % 5) WHEN l_partkey % 5 = l_partkey % 7 THEN '' ELSE '-' || (l_partkey % 5) END AS ref FROM lineitem""")
def ref_format(spark, d):
    li = table(spark, d, "lineitem")
    end = F.when(F.col("l_orderkey") % 2 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber"))
    ref = tx.reference(F.concat(F.lit("B"), F.col("l_suppkey")), F.col("l_linenumber"), (F.col("l_partkey") % 7).cast("string"), end, (F.col("l_partkey") % 5).cast("string"))
    return li.select("l_orderkey", "l_linenumber", ref.alias("ref"))


def _sql_class(chars: str) -> str:
    return tx.char_class(chars).replace("'", "''")


@query(f"""SELECT doc_id, md5(lower(replace(replace(translate(regexp_replace(text, '{_sql_class(tx.PROMPT_CHARS + tx.PUNCTUATION + tx.QUOTES)}', '', 'g'), '{tx.HYPHENS}', '------'), '’', ''''), '‘', ''''))) AS clean_md5 FROM documents""")
def cleanup_punct(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.cleanup(F.col("text"))).alias("clean_md5"))


@query("SELECT o_orderkey, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 5, '0') || CASE WHEN o_orderkey % 4 = 0 THEN 'r' ELSE '' END AS filled FROM orders")
def zero_fill(spark, d):
    s = F.concat(F.col("o_orderkey") % 1000, F.when(F.col("o_orderkey") % 4 == 0, "r").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", tx.zero_fill(s).alias("filled"))


@query("SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_size || 'a' END, '^([0-9]+)', 1), '') AS INT), 0) AS verse_num FROM part")
def safe_verse_num(spark, d):
    s = F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.concat("p_size", F.lit("a")))
    return table(spark, d, "part").select("p_partkey", tx.leading_int(s).alias("verse_num"))


@query("SELECT conv_id, turn, md5(regexp_replace(translate(lower(text), '’', ''''), '[^a-z'']+', '', 'g')) AS norm_md5 FROM conversations")
def uroman_norm(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(tx.uroman_normalize(F.col("text"))).alias("norm_md5"))


@query("SELECT item_id, regexp_replace('{' || item_id || '} ' || text || ' {' || item_id || '-' || (item_id + 1) || '} end', '\\{[0-9\\-,]+\\}\\s?', '', 'g') AS stripped FROM benchmark")
def strip_marks(spark, d):
    i = F.col("item_id")
    marked = F.concat(F.lit("{"), i, F.lit("} "), F.col("text"), F.lit(" {"), i, F.lit("-"), i + 1, F.lit("} end"))
    return table(spark, d, "benchmark").select("item_id", tx.strip_verse_marks(marked).alias("stripped"))


@query("SELECT page_id, substr(md5(coalesce(url, '') || 'bucket' || 'audio'), 1, 12) AS hash_id FROM pages")
def hash12(spark, d):
    return table(spark, d, "pages").select("page_id", tx.hash_id(F.coalesce("url", F.lit("")), F.lit("bucket"), F.lit("audio")).alias("hash_id"))


@query(f"WITH {WORDS} SELECT word, count(*) AS n, (SELECT count(*) FROM scripts) AS n_sentences FROM words WHERE ttype = 'W' GROUP BY word")
def unigram_counts(spark, d):
    n = scripts(spark, d).agg(F.count("*").alias("n_sentences"))
    return words(spark, d).filter("ttype = 'W'").groupBy("word").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n))


@query("""WITH f AS (SELECT o_orderkey, 'FS' || o_custkey || '_GEN_' || (o_orderkey % 50) || CASE o_orderkey % 3 WHEN 0 THEN '.mp3' WHEN 1 THEN '.usx' ELSE '.json' END AS name FROM orders)
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'text_usx_edit' ELSE 'text_plain' END AS media, split_part(name, '_', 1) AS fileset, 'GEN' AS book_id, CAST(o_orderkey % 50 AS INT) AS chapter,
  regexp_replace(name, '\\.[^.]*$', '_bytes.csv') AS companion FROM f""")
def file_names(spark, d):
    k = F.col("o_orderkey")
    ext = F.when(k % 3 == 0, ".mp3").when(k % 3 == 1, ".usx").otherwise(".json")
    f = table(spark, d, "orders").select(k, F.concat(F.lit("FS"), "o_custkey", F.lit("_GEN_"), k % 50, ext).alias("name"))
    parts = tx.v4_name(F.col("name"))
    return f.select("o_orderkey", tx.media_type(F.col("name")).alias("media"), *[c.alias(n) for n, c in parts.items()], tx.replace_suffix(F.col("name"), "_bytes.csv").alias("companion"))


@query("SELECT CAST(sum(length(text)) AS BIGINT) AS text_length, CAST(sum(length(regexp_replace(lower(text), '[^a-z'']+', '', 'g'))) AS BIGINT) AS roman_length, coalesce(sum(length(regexp_replace(lower(text), '[^a-z'']+', '', 'g'))) * 1.2 >= sum(length(text)), false) AS covered FROM conversations")
def coverage_ratio(spark, d):
    roman = F.sum(F.length(F.regexp_replace(F.lower("text"), "[^a-z']+", "")))
    total = F.sum(F.length("text"))
    return table(spark, d, "conversations").agg(total.alias("text_length"), roman.alias("roman_length"), F.coalesce(roman * 1.2 >= total, F.lit(False)).alias("covered"))


@query(f"WITH {WORDS} SELECT script_id, count(*) FILTER (ttype = 'W') AS n_words, bool_and(true) AND string_agg(word, '' ORDER BY word_seq) = (SELECT script_text FROM scripts s WHERE s.script_id = words.script_id) AS lossless FROM words GROUP BY script_id")
def token_round_trip(spark, d):
    w = words(spark, d)
    again = w.groupBy("script_id").agg(F.count_if(F.col("ttype") == "W").alias("n_words"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_seq", "word"))), lambda s: s["word"]), "").alias("again"))
    return again.join(scripts(spark, d), "script_id").select("script_id", "n_words", (F.col("again") == F.col("script_text")).alias("lossless"))
