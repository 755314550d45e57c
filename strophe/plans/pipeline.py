"""Stages of a request over Spark tables: read text, tokenize, attach timestamps, compare, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.functions import diff, text as tx
from strophe.operators import joins
from strophe.plans.request import Compare, Request, Stage, Tables, run
from strophe.sources import sinks, text, timing
from strophe.store import Dataset


def read_lines(spark: SparkSession, r: Request) -> DataFrame:
    if r.text_data == "usx":
        lines = text.read_usx(spark, r.text_path)
    elif r.text_data in ("csv", "script"):
        lines = text.read_csv_script(spark, r.text_path)
    else:
        books = spark.createDataFrame([(b, i) for i, b in enumerate(r.books)], "book_id string, book_seq int")
        lines = text.read_plain_json(spark, r.text_path, books)
    return lines.filter(F.col("book_id").isin(*r.books) | (F.col("book_id") == "")) if r.books else lines


def to_words(lines: DataFrame) -> DataFrame:
    keys = [c for c in ("book_id", "chapter_num", "verse_str") if c in lines.columns]
    out = lines.select(*keys, F.posexplode(tx.tokens(F.col("script_text"))).alias("word_seq", "word"))
    return out.withColumn("ttype", tx.token_type(F.col("word")))


def clean(c: Compare, column: Column) -> Column:
    out = tx.cleanup(column, c.remove_prompt_chars, c.remove_punctuation, c.quotes, c.apostrophes, c.hyphens, c.lower_case)
    return diff.normalizer(c.diacritics)(out) if c.diacritics else out


def compared(base: DataFrame, comp: DataFrame, c: Compare) -> DataFrame:
    """Pairs of verses that differ in more than white space, with their differences."""
    keys = ["book_id", "chapter_num", "verse_str"]

    def ready(lines):
        return lines.withColumn("script_text", clean(c, tx.strip_verse_marks(F.col("script_text")))).withColumn("seq", F.monotonically_increasing_id() if "seq" not in lines.columns else F.col("seq"))

    pairs = joins.full_outer_compare(ready(base), ready(comp), keys, "script_text", "seq")
    pairs = pairs.withColumn("diffs", diff.char_diff(F.trim("base_text"), F.trim("comp_text"))).filter(~diff.is_match(F.col("diffs")))
    if not c.filter_threshold:
        return pairs
    pairs = pairs.withColumn("pair", F.struct(*keys))
    known = to_words(ready(base)).filter("ttype = 'W'").select("word").distinct()
    kept = diff.frequency_filter(pairs, known, "pair", c.filter_threshold)
    return pairs.drop("diffs").join(kept, "pair").drop("pair").filter(~diff.is_match(F.col("diffs")))


def plan(spark: SparkSession, r: Request, folder: str) -> list[tuple[str, Stage]]:
    """The stages of a request, in order."""
    stages: list[tuple[str, Stage]] = []
    dataset = Dataset(spark, f"{folder}/{r.dataset_name}")
    if r.text_data != "none":
        stages.append(("text", lambda t: {"scripts": read_lines(spark, r)}))
    else:
        stages.append(("open", lambda t: {"scripts": dataset.read("scripts")}))
    if r.detail != "lines":
        stages.append(("words", lambda t: {"words": to_words(t["scripts"])}))
    readers = {"tsv": timing.read_timing_tsv, "segments": timing.read_segments, "fragments": timing.read_fragments, "tokens": timing.read_tokens}
    if r.timestamps != "none":
        stages.append(("timestamps", lambda t: {"timestamps": readers[r.timestamps](spark, r.timestamps_path)}))
    if r.compare is not None:
        base = Dataset(spark, f"{folder}/{r.compare.base_dataset}")
        stages.append(("compare", lambda t: {"pairs": compared(base.read("scripts"), t["scripts"], r.compare)}))
    return stages


def execute(spark: SparkSession, r: Request, folder: str) -> Tables:
    """Run a request and store each of its tables as a new version."""
    tables = run(plan(spark, r, folder))
    dataset = Dataset(spark, f"{folder}/{r.dataset_name}")
    for name, df in tables.items():
        if name != "scripts" or r.text_data != "none":
            dataset.write(name, df)
    out = dataset.read("scripts")
    if r.output_csv:
        sinks.write_csv(out, r.output_csv)
    if r.output_json:
        sinks.write_json(out, r.output_json)
    return {name: dataset.read(name) for name in tables}
