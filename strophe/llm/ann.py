"""Approximate nearest neighbours: inverted file, product-quantised residuals, asymmetric tables, exact reranking.

1. Coarse centroids, a rotation of the residuals that spreads their variance evenly over the parts, and a codebook for
   each part are fitted on a bounded sample (`sample_rows` rows by the hash of the id). There are as many lists as the
   root of the rows; beyond `centroids` of them a second codebook cuts every centroid's list, so the sample stays bounded.
2. How many lists a query visits and how many candidates are measured exactly is not guessed: HELD queries of the
   sample are compared with all rows, once exactly and once by codes, in two linear passes that send HELD * k rows a
   task. They tell how far down the true neighbours stand, and the counts are those that reach `recall` of them. Vectors
   with clusters need few lists; vectors without any (uniform on a sphere) need half of them, as for any index.
3. Every valid row is coded. A query meets the codes of its lists, in blocks of at most about `block_rows` rows and with
   `block_queries` queries; whole blocks are ranked at once by asymmetric distance tables. A distance that the sample
   gives each query beforehand keeps the rows that go on few.
4. Ranks are merged over all blocks, and each query's best `rerank` are measured once on the original vectors in double
   precision. A query that has fewer than k results so far visits all lists, without that distance.

Defined results: vectors that are null, empty, zero, of another length than the sample's most frequent one, or hold null
or non-finite components take no part; ties go to the smaller id; rows that repeat an id are one candidate (the nearest of
them), one query (the least of their vectors) and never their own neighbour; fewer candidates than k give fewer rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import checkpoint

#: Queries that the counts of lists and candidates are measured with.
HELD = 256
RESULT = "query_id long, rank int, vec_id long, score double"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def k_means(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(rows))
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        near = squared(rows, centres).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, rows[:, d], minlength=k) for d in range(rows.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rows[rng.integers(len(rows), size=k)])
    return centres


def balanced_rotation(rest: np.ndarray, parts: int) -> np.ndarray:
    """Principal axes as columns, dealt to the parts so that the products of their variances come out alike."""
    variance, axes = np.linalg.eigh(np.cov(rest.T)) if len(rest) > 1 else (np.ones(rest.shape[1]), np.eye(rest.shape[1]))
    width, dealt, load = rest.shape[1] // parts, [[] for _ in range(parts)], np.zeros(parts)
    for i in np.argsort(-variance):
        p = min((p for p in range(parts) if len(dealt[p]) < width), key=lambda p: (load[p], p))
        dealt[p].append(i)
        load[p] += np.log(max(variance[i], 1e-12)) + 30
    return axes[:, [i for part in dealt for i in part]]


class Quantiser:
    """Coarse centroids in one or two levels, and codebooks of the parts of the rotated residuals."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, centroids: int = 2_048, rounds: int = 8, seed: int = 7, fit_rows: int = 8_000):
        rng = np.random.default_rng(seed)
        self.coarse = k_means(sample, min(lists, centroids, max(1, len(sample) // 4)), rounds, rng)
        rest = sample - self.coarse[squared(sample, self.coarse).argmin(1)]
        self.fine = k_means(rest, ceil(lists / len(self.coarse)), rounds, rng) if lists > centroids else np.zeros((1, sample.shape[1]))
        self.n_lists = len(self.coarse) * len(self.fine)
        self.dim = sample.shape[1]
        self.parts = next(p for p in range(min(parts, self.dim), 0, -1) if self.dim % p == 0)
        rest = (sample - self.centres(self.list_of(sample)))[:fit_rows]
        self.rotation = balanced_rotation(rest, self.parts)
        self.books = [k_means(x, 256, rounds, rng) for x in np.split(rest @ self.rotation, self.parts, axis=1)]

    def centres(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def list_of(self, rows: np.ndarray) -> np.ndarray:
        """Each row's own list: the nearest centroid, then the nearest cut of its residual."""
        first = squared(rows, self.coarse).argmin(1)
        return first * len(self.fine) + (squared(rows - self.coarse[first], self.fine).argmin(1) if len(self.fine) > 1 else 0)

    def lists_near(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, nearest first; of a second level, the cuts of twice as many centroids as n needs are compared."""
        far = squared(rows, self.coarse)
        k = len(self.fine)
        if k == 1:
            return np.argsort(far, axis=1, kind="stable")[:, :n]
        near = np.argsort(far, axis=1, kind="stable")[:, : 2 * ceil(n / k) + 8]
        out = []
        for x, first in zip(rows, near, strict=True):
            own = (first[:, None] * k + np.arange(k)).ravel()
            out.append(own[np.argsort(squared(x[None], self.centres(own))[0], kind="stable")[:n]])
        return np.stack(out)

    def codes_of(self, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = (rows - self.centres(lists)) @ self.rotation
        return np.stack([squared(x, b).argmin(1) for x, b in zip(np.split(rest, self.parts, axis=1), self.books, strict=True)], axis=1).astype(np.uint8)

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        return self.centres(lists) + np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], axis=1) @ self.rotation.T

    def rough(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances, queries x codes, of one list: a table for each query and part, and a sum of looked-up cells."""
        rest = np.split((queries - self.centres(np.array([which]))) @ self.rotation, self.parts, axis=1)
        total = np.zeros((len(queries), len(codes)), np.float32)
        for p, (x, book) in enumerate(zip(rest, self.books, strict=True)):
            total += squared(x, book).astype(np.float32)[:, codes[:, p]]
        return total


def neighbours(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, np.ndarray]]:
    """(query's place, vec_id, vector) of the k nearest rows of each query, its own id apart, measured exactly against all rows."""
    dim = queries.shape[1]

    def run(batches):
        best: list[list[tuple[float, int, bytes]]] = [[] for _ in queries]
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                x, own = matrix(part.column("vector"), dim), part.column("vec_id").to_numpy(zero_copy_only=False)
                far = squared(queries, x)
                far[ids[:, None] == own[None, :]] = np.inf
                near = np.argpartition(far, min(k, len(x)) - 1, axis=1)[:, :k]
                for q, places in enumerate(near):
                    limit = best[q][-1][0] if len(best[q]) >= k else np.inf
                    new = [(float(far[q, i]), int(own[i]), x[i].tobytes()) for i in places if far[q, i] < limit]
                    if new:
                        best[q] = sorted(best[q] + new)[:k]
        found = [(q, *b) for q, own in enumerate(best) for b in own]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.binary()))], names=["q", "far", "vec_id", "vector"])

    order = Window.partitionBy("q").orderBy("far", "vec_id")
    top = rows.mapInArrow(run, "q int, far double, vec_id long, vector binary").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return [(r["q"], r["vec_id"], np.frombuffer(r["vector"])) for r in top.filter("far < double('inf')").select("q", "vec_id", "vector").collect()]


def codes_before(indexed: DataFrame, quantiser: Quantiser, ids: np.ndarray, queries: np.ndarray, limits: list[np.ndarray]) -> list[np.ndarray]:
    """For each limit of each query how many of all rows have codes nearer than it."""

    def run(batches):
        counts = [np.zeros(len(x), np.int64) for x in limits]
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                own = part.column("vec_id").to_numpy(zero_copy_only=False)
                far = squared(queries, quantiser.decoded(part.column("list").to_numpy(zero_copy_only=False).astype(np.int64), codes))
                far[ids[:, None] == own[None, :]] = np.inf
                for q, x in enumerate(limits):
                    counts[q] += np.searchsorted(np.sort(far[q]), x)
        cells = [(q, i, int(n)) for q, own in enumerate(counts) for i, n in enumerate(own)]
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["q", "i", "n"])

    summed = indexed.select("vec_id", "list", "code").mapInArrow(run, "q int, i int, n long").groupBy("q", "i").agg(F.sum("n").alias("n"))
    out = [np.zeros(len(x), np.int64) for x in limits]
    for r in summed.collect():
        out[r["q"]][r["i"]] = r["n"]
    return out


def calibrate(quantiser: Quantiser, rows: DataFrame, indexed: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, recall: float) -> tuple[int, int]:
    """Lists to visit and candidates to rerank so that `recall` of the true neighbours of these queries are met by both, among all rows."""
    true = neighbours(rows, ids, queries, k)
    if not true:
        return quantiser.n_lists, k
    vectors = np.stack([v for _, _, v in true])
    of = np.array([q for q, _, _ in true])
    own = quantiser.list_of(vectors)
    approximate = quantiser.decoded(own, quantiser.codes_of(vectors, own))
    to_lists = squared(queries, quantiser.centres(np.arange(quantiser.n_lists)))
    list_ranks = (to_lists[of] < to_lists[of, own][:, None]).sum(axis=1) + 1
    limits = [np.array([squared(queries[q : q + 1], approximate[i : i + 1])[0, 0] for i in np.flatnonzero(of == q)]) for q in range(len(queries))]
    code_ranks = np.concatenate(codes_before(indexed, quantiser, ids, queries, limits)) + 1
    share = 1 - (1 - recall) / 2
    return int(np.quantile(list_ranks, share, method="higher")), int(np.quantile(code_ranks, 1 - (1 - share) / 4, method="higher"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vec_id is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("vector", lambda x: x != 0))


def nearest(
    vectors: DataFrame, query_filter: str = "vec_id % 100 = 0", k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None,
    visits: int | None = None, rerank: int | None = None, recall: float = 0.98, parts: int = 32, sample_rows: int = 20_000, centroids: int = 2_048, block_rows: int = 1_024, block_queries: int = 4_096,
) -> DataFrame:
    """query_id, rank, vec_id, score. `lists`: None for the root of the rows; `visits` (lists a query visits) and `rerank`: None to have them measured."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    n_rows = rows.count()
    sample = [(r["vec_id"], r["vector"]) for r in rows.orderBy(F.xxhash64("vec_id")).limit(sample_rows).select("vector", "vec_id").collect()]
    if not sample:
        return spark.createDataFrame([], RESULT)
    dim = Counter(len(v) for _, v in sample).most_common(1)[0][0]
    rows = rows.filter(F.size("vector") == dim)
    ids = np.array([i for i, v in sample if len(v) == dim], dtype=np.int64)
    fitted = np.array([v for _, v in sample if len(v) == dim], dtype=np.float64)
    quantiser = Quantiser(fitted, lists or max(1, round(sqrt(n_rows))), parts, centroids)
    limit = block_rows if n_rows < 8_192 * block_rows else min(ceil(n_rows / 8_192), 65_536)

    def index(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                x = matrix(part.column("vector"), dim)
                own = quantiser.list_of(x)
                codes = quantiser.codes_of(x, own)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "list", "code"])

    def probe(n: int, every: bool):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    x = matrix(part.column("vector"), dim)
                    near = np.tile(np.arange(quantiser.n_lists), (len(x), 1)) if every else quantiser.lists_near(x, n)
                    reach = np.full(len(x), np.inf) if every else np.partition(squared(x.astype(np.float32), near_sample), expected - 1, axis=1)[:, expected - 1].astype(np.float64) * 1.05 + slack
                    again = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column("vec_id").take(again), part.column("vector").take(again), pa.array(reach).take(again), pa.array(near.ravel().astype(np.int32))], names=["query_id", "query", "reach", "list"])

        return run

    def search(key, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(candidates) and len(queries):
            candidates = candidates.sort_values("vec_id", kind="stable")
            ids = candidates["vec_id"].to_numpy()
            codes = np.frombuffer(b"".join(candidates["code"]), dtype=np.uint8).reshape(len(ids), -1)
            asked, vectors_, reach = queries["query_id"].to_numpy(), np.stack(queries["query"].to_numpy()), queries["reach"].to_numpy()
            for at in range(0, len(asked), 256):
                own = asked[at : at + 256]
                far = quantiser.rough(vectors_[at : at + 256], int(key[0]), codes)
                far[own[:, None] == ids[None, :]] = np.inf
                best = np.argsort(far, axis=1, kind="stable")[:, :rerank]
                values = np.take_along_axis(far, best, axis=1)
                keep = (values <= reach[at : at + 256, None]) & np.isfinite(values)
                q, place = np.nonzero(keep)
                found.append((own[q], ids[best[q, place]], values[q, place].astype(np.float64)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "rough"], columns, strict=True)))

    indexed = checkpoint(rows.mapInArrow(index, "vec_id long, list int, code binary"))
    measured = (visits, rerank) if visits and rerank else calibrate(quantiser, rows, indexed, ids[:HELD], fitted[:HELD], k, recall)
    visits = min(visits or measured[0], quantiser.n_lists)
    rerank = max(rerank or measured[1], k)
    # of the sample, so many rows stand for three times the rows to rerank
    expected = min(ceil(3 * rerank * len(fitted) / n_rows) + 1, len(fitted))
    own = quantiser.list_of(fitted)
    near_sample = quantiser.decoded(own, quantiser.codes_of(fitted, own)).astype(np.float32)
    slack = 1e-5 * float((near_sample * near_sample).sum(1).mean())
    asked = rows.filter(query_filter).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_asked = asked.count()
    # one row for each list: their number grows with the root of the rows
    sizes = indexed.groupBy("list").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes) if quantiser.n_lists <= 100_000 else sizes

    def found_by(queries: DataFrame, n_queries: int, every: bool) -> DataFrame:
        """query_id, vec_id, score: the exact distances of each query's best candidates."""
        share = 1 if every else visits / quantiser.n_lists
        salts = max(1, ceil(n_queries * share / block_queries))
        spread = indexed.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).drop("blocks")
        probed = queries.mapInArrow(probe(visits, every), "query_id long, query array<double>, reach double, list int").join(sizes, "list")
        probed = probed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int")).drop("blocks")
        keys = ["list", "block", "salt"]
        rough = spread.groupBy(*keys).cogroup(probed.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, rough double")
        order = Window.partitionBy("query_id").orderBy("rough", "vec_id")
        best = rough.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rerank).select("query_id", "vec_id").distinct()
        pairs = best.join(queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), "query_id").join(rows, "vec_id")
        apart = F.aggregate(F.zip_with("query", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return pairs.select("query_id", "vec_id", F.sqrt(apart).alias("score")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    first = checkpoint(found_by(asked, n_asked, False))
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = checkpoint(asked.join(enough, "vec_id", "left_anti"))
    n_short = short.count()
    if n_short:
        first = first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(found_by(short, n_short, True))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
