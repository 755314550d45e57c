"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import public_tokenizers
import pytest

import corpus_pipeline
from strophe.llm import ann, html_main, mixing, pii, quality, secrets, sentencepiece_scan, simhash, suffix_dedup, token_files
from strophe.llm.common import new_folder

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "word " * 40_000 + "x" * 100_000
ROWS = [
    (1, "some words that a document has, and more of them", "en", "a", 48),
    (1, "some words that a document has, and more of them", "en", "a", 48),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "a text without an id " * 30, "en", None, 1),
    (4, LONG, "de", "b", len(LONG)),
    (5, " \n\t ", "en", "b", 4),
    (6, "é́ \U0001f600 日本語 \x00 \x1c", "ja", "c", 10),
]
EXTRA = ["fp", "ids", "row", "copy", "rate", "kept", "bucket", "grp", "n_words", "n_card", "component_id", "shuffle_key", "Text2", "mix_n", "mix_key", "mix_cdf", "mix_salt", "doc", "own_id", "u", "cdf", "n", "key", "salt", "_n_words", "__n_words", "node"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows=ROWS):
    schema = SCHEMA + "".join(f", {c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, *[f"{c} {r[0]}" for c in EXTRA]) for r in rows], schema)


def tokens(spark, docs):
    folder = new_folder(spark, "edge")
    shards = token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_files.with_starts(token_files.read(spark, folder), shards)


OPERATORS = {
    "secrets": lambda s, d: secrets.find_secrets(d),
    "tokens": tokens,
    "mixing": lambda s, d: mixing.mix(d, {"a": 1.0, "b": 1.0, "c": 1.0, "": 1.0}),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "quality": lambda s, d: quality.repetition(d),
    "suffix": lambda s, d: suffix_dedup.dedup(d),
    "pii": lambda s, d: pii.pseudonymise(d, "key"),
    "sentencepiece": lambda s, d: sentencepiece_scan.encode(d, MODEL),
}
ONE_ROW_EACH = set(OPERATORS) - {"mixing"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, table(spark)).collect()
    if name in ONE_ROW_EACH:
        assert len(got) == len(ROWS)
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).collect() == []


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages(spark, rows):
    """No stage changes or drops a column: what is left are rows of the input, but for the texts of the PII stage."""
    long = (7, "words " + " ".join(f"w{i}" for i in range(80)) + " call 212-555-0142", "en", "a", 600)
    docs = table(spark, [*rows, long] if rows else rows)
    given = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString(), name
        found = [tuple(r) for r in got.collect()]
        if name == "PII pseudonyms":
            assert len(found) == docs.count() and {r[:1] + r[2:] for r in found} == {r[:1] + r[2:] for r in given}
            assert all((r[1] in {g[1] for g in given}) == (r[0] != 7) for r in found)
        else:
            assert set(found) <= given and bool(found) == bool(rows), name
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert got.count() == docs.count()


def test_null_and_empty_are_linked(spark):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark)).collect()}
    assert {got[i]["fingerprint"] for i in (2, 3, 5)} == {"0" * 16}
    assert {got[i]["component_id"] for i in (2, 3, 5)} == {2}
    assert got[None]["component_id"] is None


def test_nulls_stay_in_near_dedup(spark):
    left = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, table(spark), "").collect()]
    assert sorted(map(str, left)) == ["1", "1", "2", "4", "6", "None"]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 0.5]), (None, [1.0, 1.0]), (8, [1.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, list string, code string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 7, 0.5)]
    assert ann.nearest(df.limit(0)).collect() == []


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "http://a.b/c", "<p>x"), (1, "no url", ""), (2, "http://A.b:80/", "<div>" * 300 + "deep"), (3, "http://a.b", "text < 3 & more")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = {(r["page_id"], r["url"]): r["text"] for r in html_main.extract(df).collect()}
    assert len(got) == len(rows) and got[(1, None)] == "" and got[(2, "http://A.b:80/")] == "deep" and got[(None, "http://a.b/c")] == "x"
    assert html_main.extract(df.limit(0)).collect() == []
