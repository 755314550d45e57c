"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import ann, divergence, html_main, mixing, pii, quality, secrets, sentencepiece_scan, simhash, suffix_dedup, token_counts, token_files, whitening
from strophe.llm.common import new_folder

#: The setting with the key of the pseudonyms, and the key of tests, which anyone can read here: it hides nothing.
PII_KEY_SETTING, PII_TEST_KEY = "spark.strophe.pii.key", "test-key-that-hides-nothing"


def pii_key(spark: SparkSession) -> str:
    """The key in the session's settings; where it is unset, as in tests and checks, the test key with a warning."""
    key = spark.conf.get(PII_KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{PII_KEY_SETTING} is unset: pseudonyms use the public test key", stacklevel=2)
    return key or PII_TEST_KEY


def tokenizer_file(name: str) -> str:
    """Vocabulary files stay where they are installed; the path is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    shards = token_files.write(documents(spark, sf_dir), folder, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_files.with_starts(token_files.read(spark, folder, with_ids=False), shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


def op4_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir), pii_key(spark))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    return sentencepiece_scan.digests(sentencepiece_scan.encode(documents(spark, sf_dir), model), model)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_token_files,
        op3_poisson_mixing,
        op4_ivf_pq,
        op5_simhash_near_dedup,
        op6_suffix_repetition,
        op7_suffix_dedup,
        op8_html_main_text,
        op9_pii_pseudonyms,
        op10_sentencepiece,
        op11_embedding_whitening,
        op12_token_counts,
        op13_source_divergence,
    )
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

#: Square-root weights, MD5 uniforms and the Poisson distribution function, as mixing.py has them.
MIXING_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(n) * (SELECT sum(n) FROM counts) / (SELECT sum(sqrt(n)) FROM counts) / n AS rate FROM counts
),
terms AS (
  SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
  FROM (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT))) AS k FROM rates)
),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, r.rate,
    (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source
       AND cdf.c <= CAST(('0x' || substr(md5('17|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0) AS copies
  FROM documents d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source
),
copied AS (SELECT *, unnest(generate_series(0, CAST(copies - 1 AS INT))) AS copy FROM drawn WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, CAST(copy AS INT) AS copy,
  md5('17:shuffle|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(copy AS VARCHAR)) AS shuffle_key
FROM copied
"""

#: Words as divergence.py has them, exact integer proportions of every group and of every language.
DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
gp AS (
  SELECT lang, source, term, n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p
  FROM cells
),
lt AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term),
lp AS (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM lt
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce((
    SELECT sum(abs(x.p - y.p)) FROM gp x JOIN gp y ON y.lang = x.lang AND y.term = x.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
),
terms AS (SELECT gp.lang, gp.source, gp.term AS item, gp.p - lp.q AS value FROM gp JOIN lp ON lp.lang = gp.lang AND lp.term = gp.term WHERE gp.n > 0 AND gp.p > lp.q),
ranked AS (
  SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES: dict[str, str] = {"op3_poisson_mixing": MIXING_SQL, "op13_source_divergence": DIVERGENCE_SQL}
