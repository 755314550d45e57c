"""Operators on texts against brute force."""

import hashlib
import os
import random
import re
import tempfile
import time
import uuid
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from strophe.llm import html_main, mixing, pii, quality, secrets, sentencepiece_scan as sps, simhash, suffix_dedup, token_files
from strophe.llm.common import new_folder

DIR = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


# --- quality rules


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_quality(text, min_repeat):
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    longest = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            if i != j and w[i] == w[j]:
                n = 0
                while max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                longest[i] = max(longest[i], n)
    cover = {k for i, n in enumerate(longest) if n >= min_repeat for k in range(i, i + n)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if words_of(line):
            dup += line in seen
            seen.add(line)
    top = max([n for n in longest if n >= min_repeat], default=0)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), len(cover), top)


def test_quality_counts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "b", "é", "#x"]) + rng.choice([" ", "\n", " \n", "  "]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows.append((99, "one two three four five\n" * 40))
    got = quality.repetition(spark.createDataFrame(rows, "doc_id long, text string"), min_repeat=4).collect()
    for r in got:
        assert tuple(r[c] for c in quality.COLUMNS[:5] + quality.COLUMNS[5:]) == tuple(
            dict(zip(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"], brute_quality(dict(rows)[r["doc_id"]], 4), strict=True))[c] for c in quality.COLUMNS
        )
    assert not next(r for r in got if r["doc_id"] == 99)["kept"]


def test_quality_keeps_clean_and_rejects_repeats(spark):
    clean = " ".join(f"w{i}" for i in range(300))
    long_repeat = " ".join(f"w{i}" for i in range(400)) + " " + " ".join(f"w{i}" for i in range(120)) + " " + " ".join(f"v{i}" for i in range(900))
    rows = [(1, clean), (2, clean[:100]), (3, long_repeat)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.repetition(df).collect()} == {1: (False, True), 2: (True, False), 3: (False, False)}
    assert [r["doc_id"] for r in quality.filter_kept(df).collect()] == [1]


# --- SimHash


def brute_fingerprint(text):
    w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, radius):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark, docs, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps, 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize(("radius", "cap"), [(2, 256), (2, 3), (1, 256), (1, 3)])
def test_links_connect_the_same(spark, radius, cap):
    rng = random.Random(radius * 100 + cap)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = set()
    for _ in range(260):
        x = rng.choice(seeds)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    numbered = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(simhash.signed(f), i) for i, f in numbered.items()], "fp long, node long")
    edges = simhash.links(nodes, radius, cap)
    for e in edges.collect():
        assert e["u"] < e["v"] and (numbered[e["u"]] ^ numbered[e["v"]]).bit_count() <= radius
    comp = {r["node"]: r["component"] for r in simhash.connected_components(edges).collect()}
    assert {i: comp.get(i, i) for i in numbered} == brute_components(numbered, radius)


def test_plans_miss_no_close_pair():
    both = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    rng = random.Random(9)
    sizes = set()
    for n in (1_000, 10**6, 10**11):
        for radius in (1, 2):
            chosen = simhash.plan(n, both * n, radius)
            sizes.add(tuple(t for _, t in chosen))
            for _ in range(500):
                mask = sum(1 << b for b in rng.sample(range(64), radius))
                assert any(sum(mask >> b & 1 for b in bits) <= t for bits, t in chosen)
    assert len(sizes) > 1


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r["component"] for r in simhash.connected_components(edges).collect()} == {0}


# --- suffix-array dedup


def brute_dedup(texts, n):
    first, out = {}, {}
    for i in sorted(texts):
        raw = texts[i].encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - n + 1):
            if first.setdefault(raw[s : s + n], i) < i:
                gone[s : s + n] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_dedup(spark, docs, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs).collect()}
    assert got == brute_dedup(texts, 50)


@pytest.mark.parametrize("hot", [4_096, 3])
@pytest.mark.parametrize("alphabet", ["a", "ab", "abcé "])
def test_suffix_dedup_on_repetitive_texts(spark, alphabet, hot):
    rng = random.Random(len(alphabet))
    texts = {i: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(df, length=30, piece_bytes=500, hot_strings=hot).collect()}
    assert got == brute_dedup(texts, 30)


def one_line_in_many_contexts(n, rng):
    """Documents that share a 44-byte line, each with text of its own around it, some with the text of another."""
    line = "published under the terms of a free licence."
    own = ["".join(rng.choice("abcdefghijklmnop") for _ in range(40)) for _ in range(n)]
    return {i: f"{own[i]} {line} {own[i if i % 7 else i // 2]}" for i in range(n)}


def test_suffix_dedup_of_a_hot_line(spark):
    texts = one_line_in_many_contexts(1_500, random.Random(4))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_dedup(texts, 50)
    assert sum(n > 0 for _, n, _, _ in want.values()) > 100
    for hot in (4_096, 50):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(df, hot_strings=hot).collect()}
        assert got == want


def test_a_hot_line_of_many_documents_is_dealt_evenly(spark, monkeypatch):
    """50,000 documents with the line: no call of the merge gets more than a small share of their strings."""
    texts = one_line_in_many_contexts(50_000, random.Random(6))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    folder = tempfile.mkdtemp()
    kept = suffix_dedup.least_owner

    def counted(strings, *rest):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(strings)))
        return kept(strings, *rest)

    monkeypatch.setattr(suffix_dedup, "least_owner", counted)
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.dedup(df).select("doc_id", "n_removed", "kept_sha256").collect()}
    assert got == {i: (n, digest) for i, (_, n, _, digest) in brute_dedup(texts, 50).items()}
    sizes = [int(open(f"{folder}/{f}").read()) for f in os.listdir(folder)]
    assert max(sizes, default=0) < 5_000


def test_merged_transforms_order_suffixes():
    rng = random.Random(5)
    for length in (1, 3, 6):
        strings = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 25))) for _ in range(30)})
        owner, shard = np.array([rng.randrange(9) for _ in strings]), np.array([rng.randrange(4) for _ in strings])
        least = {}
        for s, o in zip(strings, owner, strict=True):
            for i in range(len(s) - length + 1):
                least[s[i : i + length]] = min(least.get(s[i : i + length], 99), o)
        want = [[least[s[i : i + length]] for i in range(len(s) - length + 1)] for s in strings]
        assert [x.tolist() for x in suffix_dedup.least_owner(strings, owner, shard, length)] == want


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(8)
    raw = np.frombuffer("".join(rng.choice("abcdefgh ") for _ in range(5_000)).encode(), np.uint8)
    offsets = np.array([0, 1_700, 1_700, 5_000])

    def windows():
        row, start, last, seed, _ = suffix_dedup.segments(raw, offsets, 50)
        return {(r, s): h for r, a, b, h in zip(row, start, last, seed, strict=True) for s in range(a, b + 1)}

    whole = windows()
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    assert windows() == whole and len(whole) == 1_651 + 3_251


# --- secrets


def test_secret_patterns(spark, docs, texts):
    extra = {10_001: "k = AKIA" + "Z9" * 8 + " AKIAshort PASSWORD='abc' Api-Key api_key: \"abcdefgh\" é token=12345678x", 10_002: "0123456789abcdef" * 2 + "G" + "ab" * 20}
    both = texts | extra
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs.select("doc_id", "text").union(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))).collect()}
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in both.items():
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    assert got[10_001]["n_assign"] == 2 and got[10_001]["n_access"] == 1


def test_random_keys_are_found_and_prose_is_not(spark):
    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    prose = "the quick committee considered several reasonable proposals before lunch and " * 3
    rows = [(i, f"{prose} {''.join(rng.choice(alphabet) for _ in range(48))} {prose}") for i in range(120)]
    rows += [(1_000 + i, f"{prose} src/main/resources/configuration/application {prose} aaaaaaaaaaaaaaaaaaaaaaaaaaaa") for i in range(30)]
    got = {r["doc_id"]: r["n_random"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(120)) >= 100
    assert sum(got[1_000 + i] for i in range(30)) <= 2


PROSE = "The quick committee considered several reasonable proposals before lunch and decided that none of the 14 projects could continue without further money from a large fund"
SYMBOLS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}
SYMBOLS["base64url"] = SYMBOLS["base62"] + "-_"


def test_recall_and_false_share_of_planted_keys(spark):
    """Keys by encoding and length among prose with long words, paths and identifiers: recall of each and the share of reported spans that are no keys."""
    rng = random.Random(12)
    words = re.findall(r"\w+", PROSE)
    rows, planted = [], {}

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    for encoding, symbols in SYMBOLS.items():
        for length in (20, 24, 31, 40, 64):
            for _ in range(20):
                planted[len(rows)] = (encoding, length)
                rows.append(f"{prose(60)} {''.join(rng.choice(symbols) for _ in range(length))} {prose(60)}")
    for _ in range(1_500):
        parts = [rng.choice(words) for _ in range(5)]
        rows.append(f"{prose(80)} {'/'.join(parts)}/index {'_'.join(parts)} {''.join(w.capitalize() for w in parts)} {''.join(parts).lower()} {prose(40)}")
    got = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    recall = defaultdict(float)
    for i, key in planted.items():
        recall[key] += (got[i]["n_random"] + got[i]["n_hex"] > 0) / 20
    false = sum(r["n_random"] for i, r in got.items() if i not in planted)
    share = false / max(sum(r["n_random"] for r in got.values()), 1)
    print({f"{e} {n}": round(x, 2) for (e, n), x in recall.items()}, "false share", share)
    assert share <= 0.08
    assert all(x >= 0.75 for (_, n), x in recall.items() if n >= 24) and np.mean(list(recall.values())) >= 0.85


def test_a_rare_class_reports():
    decoys = {(1, c): np.bincount([0] * 4_000 + [3] * 5, minlength=101) for c in (1, 2, 3)}
    runs = {(1, 1): np.bincount([0] * 50, minlength=101), (1, 6): np.bincount([60], minlength=101)}
    found = secrets.significant(runs, decoys, 0.05, 1_000)
    assert found[1, 6] <= 60 and found[1, 1] > 0
    assert secrets.significant({(1, 1): np.bincount([0] * 50, minlength=101)}, decoys, 0.05, 1_000) == {}


def test_random_tokens_look_random():
    rng = random.Random(1)
    p = [secrets.randomness("".join(rng.choice("0123456789abcdef") for _ in range(40))) for _ in range(400)]
    assert 0.3 < np.mean(p) < 0.7
    assert secrets.randomness("internationalizationandlocalization") < 0.01


# --- mixing


def test_mixing_rates_and_counts(spark):
    rows = [(i, "a" if i < 6_000 else "b" if i < 8_000 else None, str(i)) for i in range(9_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"a": 0.25, "b": 0.75}
    got = mixing.mix(df, weights, total=4_000).toPandas()
    n = Counter(got["source"])
    assert set(n) == {"a", "b"} and abs(n["a"] - 1_000) < 150 and abs(n["b"] - 3_000) < 250
    counts = Counter(got["doc_id"])
    b = [counts.get(i, 0) for i in range(6_000, 8_000)]
    assert abs(np.var(b) / np.mean(b) - 1) < 0.15
    assert all(sorted(g) == list(range(len(g))) for g in got.groupby("doc_id")["copy"].apply(list))
    again = mixing.mix(df, weights, total=4_000, broadcast_sources=0).toPandas()
    assert sorted(zip(got["doc_id"], got["copy"], strict=True)) == sorted(zip(again["doc_id"], again["copy"], strict=True))


def test_poisson_distribution(spark):
    from math import exp, factorial

    rates = [0.3, 4.0, 900.0, 20_000.0]
    got = {r["key"]: r["cdf"] for r in mixing.poisson_cdf(spark.createDataFrame(list(enumerate(rates)), "key long, rate double"), "key").collect()}
    for i, rate in enumerate(rates):
        cdf = got[i]
        assert abs(cdf[-1] - 1) < 1e-8 and all(x <= y for x, y in zip(cdf, cdf[1:], strict=False))
        assert 0.45 < cdf[int(rate)] < 1
        if rate < 10:
            assert abs(cdf[3] - sum(exp(-rate) * rate**k / factorial(k) for k in range(4))) < 1e-12


# --- PII


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    text = "card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112; +1 (017) 555-7713 or 017-555-7713; 10.0.0.255 not 10.0.0.256; born 1999-12-31 = 31/12/1999, not 1999-13-31; ssn 123-45-6789 not 000-45-6789; DE89370400440532013000; a.b7@mail3.example.com."
    docs = spark.createDataFrame([(1, text, "4111111111111111"), (2, text, None)], "doc_id long, text string, other string")
    rows = pii.pseudonymise(docs, "k1").orderBy("doc_id").collect()
    new = rows[0]["text"]
    assert rows[1]["text"] == new and rows[0]["other"] == "4111111111111111"
    assert [rows[0][f"n_{k}"] for k in pii.KINDS] == [2, 2, 1, 1, 2, 1, 1]
    for kept in ("not 4111111111111112", "not 10.0.0.256", "not 1999-13-31", "not 000-45-6789"):
        assert kept in new
    for gone in ("4111 1111 1111 1111", "4111111111111111,", "555-7713", "10.0.0.255", "1999-12-31", "123-45-6789", "DE89370400440532013000", "a.b7@"):
        assert gone not in new
    spaced, plain = re.search(r"card ([\d ]+) and (\d+),", new).groups()
    assert spaced.replace(" ", "") == plain and luhn(plain) and len(spaced) == 19
    iso, dmy = re.search(r"born (\d{4}-\d\d-\d\d) = (\d\d/\d\d/\d{4})", new).groups()
    assert "-".join(reversed(dmy.split("/"))) == iso
    iban = re.search(r"DE\d{20}", new)[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii.replace_all(new, b"k1", back=True)[0] == text
    assert pii.replace_all(text, b"k2")[0] != new


def test_phones_stay_numbers_of_their_plan():
    for value in ("212-555-0142", "(415) 555-2671", "+1 650.253.0000", "017-555-7713", "911-555-1234"):
        new = pii.pseudonym("phone", value, b"k")
        assert new != value and pii.pseudonym("phone", new, b"k", back=True) == value
        own, other = ("".join(c for c in x if c.isdigit())[-10:] for x in (value, new))
        assert pii.dialled(own) == pii.dialled(other)


def test_key_is_a_setting(spark, monkeypatch):
    from strophe.llm import queries

    with pytest.warns(UserWarning, match="test key"):
        assert queries.pii_key(spark) == queries.PII_TEST_KEY
    spark.conf.set(queries.PII_KEY_SETTING, "mine")
    assert queries.pii_key(spark) == "mine"
    spark.conf.unset(queries.PII_KEY_SETTING)


@pytest.mark.parametrize("size", [2, 7, 100, 1_000])
def test_permutation(size):
    got = [pii.permute(x, size, b"k", "t") for x in range(size)]
    assert sorted(got) == list(range(size))
    assert [pii.permute(y, size, b"k", "t", back=True) for y in got] == list(range(size))


def test_month_first_dates_stay_apart():
    for value in ("12/31/1999", "31.12.1999"):
        new = pii.pseudonym("dmy", value, b"k")
        assert new != value and pii.pseudonym("dmy", new, b"k", back=True) == value


# --- token files


def test_token_files(spark, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = {10_000: "a\x1cb \x85c d", 10_001: "it's <|endoftext|> 'Something é　x", 10_002: ""}
    both = texts | odd
    table = docs.select("doc_id", "text").union(spark.createDataFrame(list(odd.items()), "doc_id long, text string"))
    folder = new_folder(spark, "tokens")
    shards = token_files.write(table, folder, path, 2, shard_chars=50_000)
    got = token_files.with_starts(token_files.read(spark, folder), shards).orderBy("doc_id").collect()
    assert shards.count() > 2
    tokenizer, start = Tokenizer.from_file(path), 0
    for r, (i, t) in zip(got, sorted(both.items()), strict=True):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, start, len(ids), ids)
        assert r["ids_crc32"] == crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_other_tokenizers_encode_whole_texts(texts, tmp_path):
    """A tokenizer that keeps case, and one of bytes: the ids are the library's, not those of words by themselves."""
    import json

    from tokenizers import Tokenizer

    own = json.loads(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())
    assert token_files.words_apart(own)
    own["normalizer"]["normalizers"].pop()
    cased = tmp_path / "cased.json"
    cased.write_text(json.dumps(own))
    for path in (str(cased), public_tokenizers.path("byte_bpe_50k.json")):
        tokenizer = Tokenizer.from_file(path)
        assert not token_files.words_apart(json.loads(tokenizer.to_str()))
        sample = [*list(texts.values())[:20], "MiXed Case  and  spaces\n"]
        got = token_files.word_encoder(path)[0](sample)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in sample]


def test_each_letter_as_the_library_has_it():
    """Also letters whose lower case lies outside the plain ranges: they do not end a run of letters."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    sample = ["", " ", "Əli aȺb Ɔkɔ\tƁata9(Ɗa)", *[f"a{chr(c)}B {chr(c)} x{chr(c)}{chr(c)}9 {chr(c)}'s" for c in range(1, 0x3000)]]
    got = token_files.word_encoder(path)[0](sample)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in sample]


def test_words_share_their_units():
    """Capitals, digits and symbols make no new units: words are cut and looked up as arrays, not one by one."""
    words = ["Word", "", "(word)", "WORD12...", "d'Été", "Été", "word"]
    units, first = token_files.units_of(pa.array(words, pa.large_string()))
    assert units.to_pylist() == ["word", "(", "word", ")", "word", "1", "2", "...", "d'Été", "été", "word"]
    assert first.tolist() == [0, 1, 1, 4, 8, 9, 10, 11]
    units, first = token_files.units_of(pa.array([], pa.large_string()))
    assert (units.to_pylist(), first.tolist()) == ([], [0])


def test_shard_random_access():
    rows = [(5, np.arange(70_000, dtype="<u4").tobytes()), (None, b""), (7, np.array([3, 2], "<u4").tobytes())]
    shard = token_files.Shard(token_files.shard_bytes(rows, 4, b"", 3), b"")
    assert shard.document(2).tolist() == [3, 2] and len(shard.document(1)) == 0 and shard.document(0)[-1] == 69_999
    with pytest.raises(ValueError):
        token_files.Shard(token_files.shard_bytes(rows, 4, b"", 3), b"other")


# --- SentencePiece


def exhaustive(v, text):
    best = {0: (0.0, ())}
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.reach), end):
            piece = text[start:end]
            score = v.ids[piece][1] if piece in v.ids else v.unknown if end - start == 1 else None
            if score is not None and start in best and (end not in best or best[start][0] + score > best[end][0]):
                best[end] = (best[start][0] + score, (*best[start][1], piece))
    return [i for p in best[len(text)][1] for i in ([v.ids[p][0]] if p in v.ids else [v.bytes[b] for b in p.encode()])]


def test_sentencepiece(spark, docs, texts):
    v = sps.vocabulary(MODEL)
    short = {i: t for i, t in texts.items() if len(t) < 1_500} | {9_000: "  two  spaces\n\n日本 \U0001f600▁x", 9_001: "unbroken" * 60}
    df = spark.createDataFrame(list(short.items()), "doc_id long, text string")
    plain = {r["doc_id"]: r["ids"] for r in sps.encode(df, MODEL).collect()}
    for i in list(short)[:12] + [9_000, 9_001]:
        assert plain[i] == exhaustive(v, "▁" + short[i].replace(" ", "▁"))
    for chunk in (37, 200):
        giant = {r["doc_id"]: r["ids"] for r in sps.encode(df, MODEL, giant=50, chunk=chunk).collect()}
        assert giant == plain
    back = {r["doc_id"]: r["text"] for r in sps.decode(sps.encode(df, MODEL), MODEL).collect()}
    assert all(back[i] == t for i, t in short.items() if "▁" not in t)


def test_giant_text_in_bounded_time(spark):
    """5 MB in one document, unbroken stretches included: the same ids as word by word, and the text comes back."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 12))) for _ in range(3_000)]
    text = " ".join(rng.choice(words) for _ in range(720_000)) + "x" * 100_000
    assert len(text) > 5_000_000
    began = time.perf_counter()
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in sps.encode(df, MODEL).collect()}
    assert got[1] == np.frombuffer(sps.vocabulary(MODEL).encode(text), "<i4").tolist() and got[3] == []
    assert time.perf_counter() - began < 240
    back = sps.decode(spark.createDataFrame([(1, got[1]), (2, None), (None, []), (4, [])], "doc_id long, ids array<int>"), MODEL).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {1: text, 2: "", None: "", 4: ""}


def test_whole_table_round_trip(spark, docs, texts):
    encoded = sps.encode(docs, MODEL, giant=20_000)
    assert {r["doc_id"]: r["text"] for r in sps.decode(encoded, MODEL).collect()} == texts


def test_transfer_matrices_compose():
    v = sps.vocabulary(MODEL)
    text = "▁the▁quick▁brown▁fox▁jumps▁over▁the▁lazy▁dog▁again▁and▁again"
    whole = v.transfer(text, len(text))
    for cut in (1, 7, 20, 33):
        a, b = v.transfer(text, cut), v.transfer(text[cut:], len(text) - cut)
        both = (a[:, :, None] + b[None, :, :]).max(axis=1)
        assert np.array_equal(both[:, 0], whole[:, 0])


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<header>Site</header><div class="cookie-notice">We use cookies</div><div class="wrap-%d"><div class="sidebar">Other stories of the day that are long enough to count</div>
<article class="post"><h1>Head &amp; line</h1><p>First   <b>bold</b> text<br>goes on.<p>Second &lt;para&gt; <a href="x">linked</a></p><script>var x = "</p>";</script>
<form>Subscribe now</form><ul><li>one<li>two</ul></article><div id="comments"><p>A reader says a lot of things here, and many more words than the article has at all, again and again.</p></div></div>
<footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://www.host{i % 2}.com/{i}", PAGE % i) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = "Head & line\nFirst bold text goes on.\nSecond <para> linked\none\ntwo"
    for hosts in (10_000, 0):
        got = html_main.extract(df, broadcast_hosts=hosts).collect()
        assert {r["text"] for r in got} == {want} and {r["n_chars"] for r in got} == {len(want)}


def test_host_consensus_beats_one_page(spark):
    body = "<body><div class='c{n}'><div class='main{n}'><p>{m}</p></div><div class='box'><p>{b}</p></div></div></body>"
    rows = [(i, "http://h.org/", body.format(n=i, m="main words " * 30, b="box")) for i in range(8)]
    rows.append((8, "http://h.org/x", body.format(n=8, m="short main", b="a box that is longer here " * 10)))
    got = {r["page_id"]: r["text"] for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[8] == "short main"
