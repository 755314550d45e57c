"""Readers of timestamps: tab-separated timings and the JSON of recognisers and aligners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions import numbers as nx


def read_timing_tsv(spark: SparkSession, path: str, verse_zero: bool = True) -> DataFrame:
    """file, verse_str, begin_ts, end_ts; with verse_zero each file also has verse 0, from 0 to its first begin."""
    rows = spark.read.csv(path, sep="\t", schema="begin_ts double, end_ts double, verse string").select(F.input_file_name().alias("file"), "*")
    rows = rows.select("file", F.coalesce(F.nullif(F.ltrim("verse", F.lit("0")), F.lit("")), F.lit("0")).alias("verse_str"), "begin_ts", "end_ts")
    if not verse_zero:
        return rows
    zero = rows.groupBy("file").agg(F.min("begin_ts").alias("end_ts")).select("file", F.lit("0").alias("verse_str"), F.lit(0.0).alias("begin_ts"), "end_ts")
    return zero.unionByName(rows)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """file, id, begin_ts, end_ts, text of a recogniser's {segments: [...]} files."""
    raw = spark.read.schema("segments array<struct<id: long, start: double, end: double, text: string>>").json(path, multiLine=True)
    return raw.select(F.input_file_name().alias("file"), F.inline("segments")).select("file", "id", nx.round_ms(F.col("start")).alias("begin_ts"), nx.round_ms(F.col("end")).alias("end_ts"), F.trim("text").alias("text"))


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, id, begin_ts, end_ts of an aligner's {fragments: [...]} files, whose numbers are strings."""
    raw = spark.read.schema("fragments array<struct<id: string, begin: string, end: string, lines: array<string>>>").json(path, multiLine=True)
    return raw.select(F.input_file_name().alias("file"), F.inline("fragments")).select("file", F.col("id").try_cast("int").alias("id"), F.col("begin").try_cast("double").alias("begin_ts"), F.col("end").try_cast("double").alias("end_ts"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """file, word, seq, label, begin_ts, end_ts, score of {ratio, dictionary, tokens} files: tokens are [label, first frame, last frame, score] by word."""
    raw = spark.read.schema("ratio double, dictionary map<string, int>, tokens array<array<array<double>>>").json(path, multiLine=True)
    names = F.map_from_entries(F.transform(F.map_entries("dictionary"), lambda e: F.struct(e["value"], e["key"])))
    words = raw.select(F.input_file_name().alias("file"), "ratio", names.alias("names"), F.posexplode("tokens").alias("word", "chars"))
    chars = words.select("file", "ratio", "names", "word", F.posexplode("chars").alias("seq", "c"))
    t = F.col("c")
    return chars.select("file", "word", "seq", F.col("names")[t[0].cast("int")].alias("label"), (t[1] * F.col("ratio")).alias("begin_ts"), (t[2] * F.col("ratio")).alias("end_ts"), t[3].alias("score"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """file, audio_file, verse_str, text, uroman, begin_ts, end_ts of an aligner's [{audio_file, sections}] files: the first chapter of each file. A section without both times raises."""
    section = "struct<verse_id: string, timings: array<double>, text: string, uroman_tokens: string>"
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"array<struct<audio_file: string, sections: array<{section}>>>")[0].alias("c"))
    rows = raw.select("file", F.col("c.audio_file").alias("audio_file"), F.inline("c.sections"))

    def time(i):
        return F.when(F.size("timings") > 1, F.col("timings")[i]).otherwise(F.raise_error(F.concat(F.lit("missing timestamps for "), F.col("verse_id"))).cast("double"))

    return rows.select("file", "audio_file", F.col("verse_id").alias("verse_str"), "text", F.col("uroman_tokens").alias("uroman"), time(0).alias("begin_ts"), time(1).alias("end_ts"))


def read_manifest(spark: SparkSession, path: str, references: DataFrame) -> DataFrame:
    """script_id, begin_ts, end_ts (milliseconds rounded) of an aligner's file of JSON lines, which stand in the order of references (seq from 0, script_id). Other numbers of lines raise."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value", F.lit("\n")), "\n")).alias("seq", "line"))
    rows = lines.select("seq", F.from_json("line", "audio_start_sec double, duration double").alias("r"))
    n, wanted = rows.count(), references.count()
    if n != wanted:
        raise ValueError(f"{n} lines for {wanted} references")
    start = F.col("r.audio_start_sec")
    return rows.join(references, "seq").select("script_id", nx.round_ms(start).alias("begin_ts"), nx.round_ms(start + F.col("r.duration")).alias("end_ts"))


def verse_pieces(segments: DataFrame, pieces: DataFrame) -> DataFrame:
    """file, verse_str, texts, begin_ts, end_ts: the segments heard in each piece of a recording, moved by the piece's begin. segments: file, id, begin_ts, end_ts, text; pieces: file, verse_str, piece_begin."""
    heard = segments.groupBy("file").agg(F.min_by("begin_ts", "id").alias("b"), F.max_by("end_ts", "id").alias("e"), F.transform(F.sort_array(F.collect_list(F.struct("id", "text"))), lambda s: s["text"]).alias("texts"))
    return pieces.join(heard, "file").select("file", "verse_str", "texts", (F.col("b") + F.col("piece_begin")).alias("begin_ts"), (F.col("e") + F.col("piece_begin")).alias("end_ts"))
