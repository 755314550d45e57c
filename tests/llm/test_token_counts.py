"""The compiled transducer against the library, its borders against merging, and the scan over chunks of giant texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strophe.llm import token_counts
from strophe.llm.queries import op12_token_counts
from tests.llm.test_edges import LONG, ROWS, table

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "aabbcdest'rvlm  .,!?-_09²½éÉßñ日本語ΣσİǺ\x00\x1c\x85\n\U0001f600한글가각<|́각"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_equals_the_library(library):
    rng = random.Random(8)
    texts = [*odd_texts(1, 1_500, 60), "", "'", "''s", "it's", "'re'r", "x'l", "'rest", "'l", "a<|endoftext|>b <|startoftext|>", "x" * 30_000, "xy" * 3_000, "e" * 5_000 + "'ll" * 700, "日本語" * 2_000]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5_000)) for _ in range(3)]
    got = token_counts.transducer(PATH).count(texts)
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_full_cache_starts_anew(monkeypatch, library):
    own = token_counts.Transducer(PATH)
    monkeypatch.setattr(token_counts, "STATES_KEPT", 50)
    for text in odd_texts(2, 5, 400):
        assert own.count([text])[0] == len(library.encode(text, add_special_tokens=False).ids)


def test_maps_compose_like_the_walk_over_both():
    own = token_counts.transducer(PATH)
    text = "".join(random.Random(4).choices("etaoinshr'", k=900))
    whole = own.chunk_map("", text, True)
    a = dict((e, (x, n)) for e, x, n in own.chunk_map("", text[:400], False))
    b = dict((e, (x, n)) for e, x, n in own.chunk_map(text[300:400], text[400:700], False))
    c = dict((e, (x, n)) for e, x, n in own.chunk_map(text[600:700], text[700:], True))
    for total in (token_counts.composed([a, b, c]), token_counts.composed([token_counts.composed([a, b]), c]), token_counts.composed([a, token_counts.composed([b, c])])):
        assert total[token_counts.BEGIN] == whole[0][1:]


def test_cuts_never_part_what_normalisation_joins():
    own = token_counts.transducer(PATH)
    for text in odd_texts(3, 200, 400):
        at = token_counts.cuts(text, 16, own.special, own.longest_special)
        parts = [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]
        assert "".join(parts) == text and all(parts[1:] and len(p) for p in parts[1:])
        one = own.library.normalizer.normalize_str
        assert " ".join("".join(map(one, parts)).split(" ")).replace("  ", " ") == one(text).replace("  ", " ")


def test_giant_texts_by_the_scan(spark, library, monkeypatch):
    rng = random.Random(6)
    texts = [*odd_texts(5, 6, 3_000), "x" * 9_000, "한글" * 3_000, "a" * 50 + "<|endoftext|>" * 300, "word and more " * 500, "".join(rng.choices("etaoinshr", k=6_000))]
    want = [(1, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2_048) for t in texts]
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    got = token_counts.count_tokens(df, PATH, giant=1_000, chunk=40)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_a_lacking_entry_is_added(spark, library, monkeypatch):
    """Maps whose guesses are all wrong: the scan finds the holes and fills them."""
    text = "q" * 170 + "uest" * 20
    monkeypatch.setattr(token_counts, "LOOK_BACK", 1)
    df = spark.createDataFrame([(7, text)], "doc_id long, text string")
    rows = df.selectExpr("'r' as row", "doc_id", "text")
    _, states = token_counts.chunk_starts(rows, PATH, 50)
    assert states.agg({"before": "max"}).first()[0] == len(library.encode(text, add_special_tokens=False).ids)
    assert states.filter("entry is null").count() == 0


def test_odd_rows_and_empty_table(spark, library):
    got = token_counts.count_tokens(table(spark), PATH, giant=100_000, chunk=30_000).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 2_048) for r in ROWS]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert len(LONG) > 100_000
    assert token_counts.count_tokens(table(spark, []), PATH).collect() == []


def test_whole_table(spark, library):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {(r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False).ids), n > 2_048) for r in docs}
    assert {tuple(r) for r in op12_token_counts(spark, folder).collect()} == want
