"""The dataset's tables as views of the driver's tables, in DataFrames and in SQL.

conversations are the script lines (chapter = conversation, verse = turn), documents the chapters of a corpus, events
the alignment timeline of an audio file (= user), embeddings the vectors, TPC-H tables the published catalog.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("script_id"), F.col("conv_id").alias("chapter_num"), F.col("turn").alias("verse_num"),
        F.col("role").alias("person"), tx.blank_if_null(F.col("text")).alias("script_text"),
    )


SCRIPTS = "scripts AS (SELECT conv_id * 100000 + turn AS script_id, conv_id AS chapter_num, turn AS verse_num, role AS person, coalesce(text, '') AS script_text FROM conversations)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scripts(spark, sf_dir).select("script_id", "chapter_num", "verse_num", F.posexplode(tx.tokens(F.col("script_text"))).alias("pos", "word"))
    return s.select("script_id", "chapter_num", "verse_num", (F.col("pos") + 1).cast("long").alias("word_seq"), "word", tx.token_type(F.col("word")).alias("ttype"))


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{tx.TOKEN_PATTERN}', 1, 's')"


SQL_TTYPE = r"CASE WHEN regexp_matches(word, '^\{[0-9]+\}') THEN 'V' WHEN regexp_matches(word, '^[\s\p{Z}]') THEN 'S' WHEN regexp_matches(word, '^[\p{L}\p{N}]') THEN 'W' ELSE 'P' END"
WORDS = f"""{SCRIPTS}, words0 AS (SELECT script_id, chapter_num, verse_num, unnest({sql_tokens("script_text")}) AS word, generate_subscripts({sql_tokens("script_text")}, 1) AS word_seq FROM scripts),
words AS (SELECT script_id, chapter_num, verse_num, CAST(word_seq AS BIGINT) AS word_seq, word, {SQL_TTYPE} AS ttype FROM words0)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, char_id, begin_ts, end_ts (seconds), score in (0, 1], event_type."""
    e = table(spark, sf_dir, "events")
    begin = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / 1e6
    return e.select(
        F.col("user_id").alias("file_id"), F.col("event_id").alias("char_id"), begin.alias("begin_ts"), (begin + F.col("value") / 100).alias("end_ts"),
        (1 / (1 + F.col("value") * F.col("value"))).alias("score"), "event_type", "value",
    )


TIMELINE = """timeline AS (SELECT user_id AS file_id, event_id AS char_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS begin_ts,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 + value / 100 AS end_ts, 1 / (1 + value * value) AS score, event_type, value FROM events)"""
