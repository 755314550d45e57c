"""Near copies at five words and 0.8 against all pairs."""

import random

import corpus_pipeline
from strophe.llm import near_copies
from tests.llm.test_edges import SCHEMA


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def test_near_dedup_reaches_the_similarity(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3_000)]
    line = [rng.choice(words) for _ in range(30)]
    rows = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 200))] + line
        for changes in (0, 0, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(" ".join(w))
    rng.shuffle(rows)
    sets = [shingles(t) for t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i: find(i) for i in range(len(rows))}
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(rows)], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.components(df).collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == {i for i, c in want.items() if c == i}


def test_recall_by_similarity(spark):
    """Isolated pairs of one similarity each: at least 0.9 of every band is linked (all but a thousandth by the keys), and nothing below 0.8."""
    rng = random.Random(11)
    rows, bands = [], {}
    for i in range(900):
        words = [f"{i}_{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 300))]
        other = list(words)
        for _ in range(rng.randrange(1, max(2, len(words) // 40))):
            other[rng.randrange(len(other))] = f"{i}_x{rng.randrange(10**6)}"
        a, b = " ".join(words), " ".join(other)
        s = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        bands.setdefault("below" if s < 0.8 else 0.8 if s < 0.85 else 0.85 if s < 0.9 else 0.9, []).append(2 * i)
        rows += [(2 * i, a, "en", "a", 0), (2 * i + 1, b, "en", "a", 0)]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.components(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = {k: sum(got[i + 1] == i for i in v) / len(v) for k, v in bands.items()}
    assert all(len(v) > 50 for v in bands.values())
    assert found.pop("below") == 0 and min(found.values()) >= 0.98


def test_a_common_passage_and_a_long_text(spark):
    """Thousands of texts that share a passage but are no near copies, and very long texts."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join(passage + [f"{i}_{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 40))]), "en", "a", 0) for i in range(2_000)]
    long = [f"l{rng.randrange(5_000)}" for _ in range(60_000)]
    rows += [(5_000, " ".join(long), "en", "a", 0), (5_001, " ".join(long[:-50] + ["x"] * 50), "en", "a", 0)]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i for i in range(2_000)} | {5_000: 5_000, 5_001: 5_000}


def test_a_text_links_its_copies_in_few_pairs(spark, monkeypatch):
    """Copies that are too far from each other and near to their source, which has not the least id: pairs grow with the copies, not with their square."""
    rng = random.Random(11)
    source = [f"w{i}" for i in range(400)]
    rows = [(500, " ".join(source))]
    for i in range(200):
        own = list(source)
        for at in rng.sample(range(5, 395, 10), 7):
            own[at] = f"x{i}y{at}"
        rows.append((i if i < 100 else i + 1000, " ".join(own)))
    made = []
    verified = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *rest: (made.append(pairs.count()), verified(pairs, *rest))[1])
    got = {r["doc_id"]: r["component_id"] for r in near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0} and len(got) == 201
    assert sum(made) < 5 * len(rows)


def test_variants_too_far_from_each_other_are_not_paired(spark, monkeypatch):
    """Variants of one text that share keys and are no near copies, some with a near copy of their own, some near the text, and ids of two texts: links as by brute force, pairs in proportion to the rows."""
    rng = random.Random(21)
    source = [f"w{i}" for i in range(200)]

    def changed(words, spots):
        words = list(words)
        for at in rng.sample(range(2, 198, 6), spots):
            words[at : at + 1] = rng.choice(([f"x{rng.randrange(10**9)}"], [], [words[at], f"y{rng.randrange(10**9)}"]))
        return words

    variants = [changed(source, 7) for _ in range(600)]
    texts = [*variants, source, *(changed(source, 2) for _ in range(40)), *(changed(v, 1) for v in variants[:90])]
    rows = [(i, " ".join(t)) for i, t in enumerate(rng.sample(texts, len(texts)))]
    rows += [(i, " ".join(changed(variants[100 + i], 1))) for i in range(20)]
    made = []
    verified = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *rest: (made.append(pairs.count()), verified(pairs, *rest))[1])
    got = {r["doc_id"]: r["component_id"] for r in near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(rows)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                root[b] = a
    want = {i: find(i) for i in range(len(texts))}
    assert len(set(want.values())) < len(texts) - 100
    assert got == want
    assert sum(made) < near_copies.BANDS * len(rows), made
