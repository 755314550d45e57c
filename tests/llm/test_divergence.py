"""The audit against its SQL over tables with ties, nulls, empty groups and many chunks."""

import random
import re

import duckdb
import numpy as np
import pytest

from strophe.llm import divergence
from strophe.llm.queries import DIVERGENCE_SQL, op13_source_divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def by_sql(documents):
    with duckdb.connect() as db:
        db.register("documents", documents)
        return sorted(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({DIVERGENCE_SQL})").fetchall())


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    with duckdb.connect() as db:
        documents = db.sql(f"SELECT * FROM '{folder}/documents.parquet'").to_arrow_table()
    got = rows_of(op13_source_divergence(spark, folder))
    assert got == by_sql(documents) and {r[2] for r in got} == {"pair", "term"}


def test_nulls_ties_and_small_chunks(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"{c}{d}" for c in "abcÀéß日Z" for d in "xyzÉ"]
    rows = []
    for i in range(900):
        lang, source = rng.choice([None, "", "en", "de"]), rng.choice([None, "s1", "s2", "é", "Z"])
        rows.append((i % 700, " ".join(rng.choices(words, k=rng.randrange(8))) + rng.choice(["", ",", "3a@b", "\x7f"]), lang, source, "x", "y", 1))
    rows += [(None, None, "xx", "s1", "x", "y", 1), (None, "", "xx", "s2", "x", "y", 2), (5, "Alone " * 40, "yy", "s1", "", "", 3), (6, "q" * 100_000, "en", "s9", "", "", 3)]
    schema = "doc_id long, text string, lang string, source string, term string, chunk string, n int"
    df = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(divergence, "LEAST", 3)
    want = by_sql(df.toArrow())
    assert rows_of(divergence.audit(df, cells=12)) == want == rows_of(divergence.audit(df))
    assert ("xx", "s1", "pair", "s2", 0, 1) in want


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_proportions_are_exact():
    rng = random.Random(9)
    for _ in range(300):
        total, v = rng.randrange(1, 10**14), rng.randrange(1, 10**6)
        count = rng.randrange(total + 1)
        want = 1 + 10**9 * (count + 5) // (total + 5 * v)
        assert int(divergence.proportions(np.int64(count), np.int64(total), v, 5)) == want


@pytest.mark.parametrize("text", ["Ab3c-d É@É\x00ß", "", "  ", "ÀB[c]{d}`e\x7ff日本"])
def test_words(text):
    import pyarrow as pa

    _, code, words = divergence.words_of(pa.array([text]))
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert [words[i].as_py() for i in code.tolist()] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
