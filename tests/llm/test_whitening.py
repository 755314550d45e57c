"""Whitening against NumPy over the whole table, and odd vectors."""

import numpy as np
import pytest

from strophe.llm import whitening
from strophe.llm.queries import op11_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string, n string, deviation string"


def brute(vectors, components=4):
    """(n, x of each row, deviation, whitened, explained) by NumPy."""
    x = np.array([[int(np.floor(256.0 * float(c))) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    with np.errstate(divide="ignore", invalid="ignore"):
        white = (x - s / n) @ axes[:, order] / np.sqrt(values[order])
        return n, ((n * x - s) ** 2).sum(axis=1), white, values[order] / values.sum()


def compare(got, ids, vectors, components=4):
    n, dev, white, explained = brute(vectors, components)
    place = {v: i for i, v in enumerate(ids)}
    sign = {}
    assert len(got) == len(ids) * components
    for r in got:
        i, k = place[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == dev[i]
        assert r["explained"] == pytest.approx(explained[k], rel=1e-6) and 0 <= r["identity_error"] < 1e-8
        if abs(white[i, k]) > 1e-6:
            assert sign.setdefault(k, np.sign(white[i, k] * r["whitened"])) == np.sign(white[i, k] * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(white[i, k])) < 1e-6


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    compare(op11_embedding_whitening(spark, folder).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PAIRS", 4)
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=5).astype("float32").tolist()) for i in range(40)]
    good += [(40 + i, good[0][1]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [1.0, float("nan"), 0.0, 0.0, 0.0]), (103, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (None, None)]
    df = spark.createDataFrame([(i, v, 1, "a", "b", "c", "d") for i, v in good + bad], SCHEMA)
    compare(whitening.whiten(df).collect(), [i for i, _ in good], [v for _, v in good])
    assert len(whitening.whiten(spark.createDataFrame([(None, v, 1, "", "", "", "") for _, v in good[:9]], SCHEMA)).collect()) == 36


def test_few_vectors_and_dimensions(spark):
    def of(rows):
        return sorted(whitening.whiten(spark.createDataFrame([(i, v, 1, "", "", "", "") for i, v in rows], SCHEMA)).collect(), key=lambda r: (r["vec_id"], r["component"]))

    assert of([]) == of([(1, None)]) == []
    one = of([(1, [0.5, -0.001]), (2, [0.5, -0.001])])
    assert [tuple(r) for r in one] == [(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)]
    line = of([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [3.0, 3.0])])
    assert [r["whitened"] is None for r in line] == [False, True] * 3
    assert line[0]["explained"] == pytest.approx(1.0) and line[0]["identity_error"] < 1e-12
    far = of([(1, [2.0**40]), (2, [-(2.0**40)])])
    assert [r["deviation"] for r in far] == [None, None] and abs(abs(far[0]["whitened"]) - 1) < 1e-12
