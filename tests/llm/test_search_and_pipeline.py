"""Nearest neighbours against brute force, the SQL of mixing, and the pipeline against its stages by hand."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from strophe.llm import ann, pii, quality, queries

DIR = "/root/testdata/sf0.001"


def brute(rows, k=10):
    x, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_neighbours(spark, hot):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16)) for i in range(1_500)]
    if hot:
        rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    want = brute(rows)
    got = {}
    for r in ann.nearest(df, block_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert all(len(v) == 10 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    exact = dict(rows)
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(float(np.sqrt(((exact[q] - exact[i]) ** 2).sum())), abs=1e-12)
    if hot:
        assert got[0] == want[0]


def recall_of(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def by_query(rows):
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_on_the_table(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in vectors.collect() if r["embedding"] is not None and any(r["embedding"])]
    got = by_query(ann.nearest(vectors).orderBy("query_id", "rank").collect())
    want = brute(rows)
    assert set(got) == set(want) and recall_of(got, want) >= 0.95


def test_clusters_need_few_lists(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(100, 32))
    x = centres[rng.integers(100, size=9_000)] + 0.4 * rng.normal(size=(9_000, 32))
    quantiser = ann.Quantiser(x, 95, 16)
    own, codes = quantiser.list_of(x), quantiser.codes_of(x, quantiser.list_of(x))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>")
    indexed = spark.createDataFrame([(i, int(k), c.tobytes()) for i, (k, c) in enumerate(zip(own, codes, strict=True))], "vec_id long, list int, code binary")
    visits, rerank = ann.calibrate(quantiser, rows, indexed, np.arange(256), x[:256], 10, 0.98)
    assert visits <= 9 and rerank <= 200
    found = []
    for i in range(0, 9_000, 90):
        exact = ann.squared(x[i : i + 1], x)[0]
        exact[i] = np.inf
        rough = np.full(9_000, np.inf)
        for which in quantiser.lists_near(x[i : i + 1], visits)[0]:
            at = np.flatnonzero(own == which)
            rough[at] = quantiser.rough(x[i : i + 1], int(which), codes[at])[0]
        rough[i] = np.inf
        best = np.argsort(rough)[:rerank]
        found.append(len(set(np.argsort(exact)[:10]) & set(best[np.argsort(exact[best])[:10]])) / 10)
    assert np.mean(found) >= 0.95


def test_two_levels_of_lists():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3_000, 8))
    quantiser = ann.Quantiser(x, 200, 4, centroids=20)
    own = quantiser.list_of(x)
    assert quantiser.n_lists == 200 and len(set(own)) > 150
    near = quantiser.lists_near(x[:100], 200)
    assert all(len(set(r)) == len(r) for r in near.tolist()) and np.mean(near[:, :3] == own[:100, None]) > 0.2


def test_repeated_rows_of_a_query(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    df = spark.createDataFrame([*rows, rows[100], rows[7], rows[7]], "vec_id long, embedding array<double>")
    got = by_query(ann.nearest(df, block_queries=1, lists=4, visits=4, rerank=60).orderBy("query_id", "rank").collect())
    want = brute([(i, np.array(v)) for i, v in rows])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_short_queries_visit_all_lists(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) + (50 if i < 3 else 0)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_query(ann.nearest(df, lists=8, visits=1, rerank=10).orderBy("query_id", "rank").collect())
    assert all(len(v) == 10 for v in got.values()) and {i for i, _ in got[0][:2]} == {1, 2}


def test_few_candidates_give_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["rank"]) for r in ann.nearest(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_mixing_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    df = queries.QUERIES["op3_poisson_mixing"](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted(tuple(r) for r in df.select(cols).collect())
    assert mine == sorted(con.sql(queries.ORACLES["op3_poisson_mixing"]).select(*cols).fetchall()) and mine


def test_pipeline(spark):
    docs = queries.documents(spark, DIR)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, DIR)
    verdict = {r["doc_id"]: r["kept"] for r in quality.repetition(docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in verdict.items() if k}
    single = stages["SimHash near-dedup"](spark, kept, DIR)
    private = {r["doc_id"]: r["text"] for r in stages["PII pseudonyms"](spark, single, DIR).collect()}
    assert private == {r["doc_id"]: pii.replace_all(r["text"], queries.PII_TEST_KEY.encode())[0] for r in single.collect()}
    final = corpus_pipeline.run(spark, DIR).collect()
    assert final and {r["doc_id"] for r in final} <= set(private) and all(r["ids"] for r in final)


def test_registry():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names if n != "pipeline"] == [f"op{i}" for i in range(1, 14)] and "pipeline" in names
