"""Counts of lists and candidates are measured against all rows, however small the sample."""

import numpy as np
import pytest

from strophe.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("clusters", [0, 40])
def test_thirty_times_the_sample(spark, clusters):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6_000, 16)).astype("float32")
    if clusters:
        x = (x * 0.2 + rng.normal(size=(clusters, 16))[rng.integers(clusters, size=6_000)]).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = ann.nearest(df, sample_rows=200, parts=4).collect()
    queries = range(0, 6_000, 100)
    y = x.astype(float)
    met = 0
    for q in queries:
        far = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        met += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert met >= 0.95 * 10 * len(queries)


def test_ranks_equal_a_plain_count(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>").repartition(5)
    ids = np.arange(0, 40)
    found = ann.neighbours(rows, ids, x[ids], 3)
    for q in range(40):
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        assert sorted(i for p, i, _ in found if p == q) == sorted(np.argsort(far)[:3].tolist())
    quantiser = ann.Quantiser(x[:100], 5, 2)
    lists = quantiser.list_of(x)
    codes = quantiser.codes_of(x, lists)
    indexed = spark.createDataFrame([(i, int(c), b.tobytes()) for i, (c, b) in enumerate(zip(lists, codes, strict=True))], "vec_id long, list int, code binary").repartition(3)
    limits = [np.array([1.0, 5.0, 20.0]) for _ in ids]
    got = ann.codes_before(indexed, quantiser, ids, x[ids], limits)
    near = quantiser.decoded(lists, codes)
    for q in range(40):
        far = ann.squared(x[q : q + 1], near)[0]
        far[q] = np.inf
        assert got[q].tolist() == [(far < v).sum() for v in limits[q]]
