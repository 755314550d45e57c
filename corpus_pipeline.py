"""A training corpus from raw documents in five stages, each an operator of strophe.llm over all that the stage before kept.

quality rules -> SimHash near-dedup -> PII pseudonyms -> mixing to target weights -> SentencePiece encoding.
Every stage's result is written as Parquet to the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.lineage import Written
from strophe.llm import mixing, near_copies, pii, quality, sentencepiece_scan
from strophe.llm.common import new_folder
from strophe.llm.queries import documents, pii_key, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; null and empty texts have too few words and go, all columns stay as they are."""
    return quality.filter_kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, similarity of 0.8 or more); rows of one id stay or go together, and null ids stay."""
    found = near_copies.components(docs)
    gone = Written(found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).filter("not stays").select("doc_id"), "gone").df
    # few enough ids are broadcast, so that no text is shuffled
    side = F.broadcast(gone) if gone.count() <= near_copies.BROADCAST else gone
    return docs.join(side, "doc_id", "left_anti").select(*docs.columns)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its validated numbers, dates and addresses; null texts stay null, all other columns stay as they are."""
    return pii.pseudonymise_text(docs, pii_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies of the documents at the square-root weights of their sources; a null source is one of its own, and no column changes."""
    return mixing.replicate(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of every document, one row for each copy; null and empty texts have an empty array."""
    return sentencepiece_scan.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("PII pseudonyms", pii_pseudonyms),
    ("mixing to target weights", mix_sources),
    ("SentencePiece encoding", sentencepiece_ids),
]

#: SQL has neither the suffix arrays nor the Feistel network; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        folder = new_folder(spark, "corpus")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
