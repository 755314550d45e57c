"""The walk around a forest against a plain one; a long chain in linear rows."""

import random

import pytest
from pyspark.sql import functions as F

from strophe.operators import tree

SCHEMA = "id long, parent_id long, good boolean"


def walk(rows):
    ids = {r[0] for r in rows}
    children = {}
    for i, p, _ in rows:
        children.setdefault(p if p in ids else None, []).append(i)
    good = {r[0] for r in rows if r[2]}
    out, at = {}, 0

    def visit(i, depth):
        nonlocal at
        enter, n = at, int(i in good)
        at += 1
        for c in sorted(children.get(i, [])):
            n += visit(c, depth + 1)
        out[i] = (enter, at, depth, n)
        at += 1
        return n

    for root in sorted(children.get(None, [])):
        visit(root, 0)
    return out


def test_forest(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 9_999, *range(max(0, i - 9), i)]) if i else None, rng.random() < 0.3) for i in range(150)]
    rows = [(3 * i - 200, None if p is None else 3 * p - 200, g) for i, p, g in rows] + [(None, 1, True)]
    df = spark.createDataFrame(rows, SCHEMA)
    indexed = tree.index(df, {"good": F.col("good")})
    want = walk(rows[:-1])
    assert {r["id"]: (r["enter"], r["exit"], r["depth"], r["good"]) for r in indexed.collect()} == want
    pairs = spark.createDataFrame([(rng.choice(rows)[0], rng.choice(rows)[0]) for _ in range(300)] + [(5_555, rows[0][0])], "a long, b long")
    for r in tree.below(pairs, indexed, "a", "b").collect():
        assert r["is_below"] == (r["a"] in want and r["b"] in want and want[r["b"]][0] <= want[r["a"]][0] <= want[r["b"]][1])


def test_chain_of_a_hundred_thousand(spark):
    n = 100_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    got = tree.index(chain)
    assert got.count() == n
    assert got.filter(f"enter != id or exit != {2 * n - 1} - id or depth != id").count() == 0


def test_cycles_and_empty(spark):
    with pytest.raises(ValueError, match="cycle"):
        tree.index(spark.createDataFrame([(1, None), (2, 3), (3, 2)], "id long, parent_id long"))
    assert tree.index(spark.createDataFrame([], "id long, parent_id long")).collect() == []
