"""SimHash near-dedup by the generalised pigeonhole principle.

If two fingerprints differ in at most r bits and the bits are dealt to m partitions with thresholds t_1..t_m that
sum to r - m + 1 (-1 skips a partition), some partition i differs in at most t_i bits. Correlated bits share a
partition, so that the other partitions tell more; dynamic programming picks the number of partitions and the
thresholds with the least estimated work. Statistics, candidates and verification cover all fingerprints.

Copies collapse into one fingerprint before anything is paired. A bucket of more than `bucket_cap` different
fingerprints is not paired at all: its members meet through keys with at most one flipped bit (two fingerprints
within two bits share such a key, and a key has 65 members at most), so work stays linear and no link is lost.

Defined results: null text counts as empty; a text without words has fingerprint 0 and links like any other; null
ids get a fingerprint and no component; repeated ids and rows stay, each with its own row; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import checkpoint, slices, text_rows

BITS = 64


def shingle_hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """The hash of each shingle; fewer words than a shingle are one."""
    n = len(words)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < shingle:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as an unsigned integer."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_of(words: list[bytes], shingle: int, seed: int) -> int:
    """Majority bits of the shingles' hashes, as an unsigned integer."""
    return majority(shingle_hashes(words, shingle, seed)) if words else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row; only A-Z are lower-cased."""

    def run(batches):
        for batch in slices(batches):
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            fps = np.array([fingerprint_of(t.as_py().lower().split(), shingle, seed) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def bit_agreement(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both set: 4,096 sums over all rows."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(raw), 1 << 14):
                part = raw[at : at + (1 << 14)]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
            n += len(raw)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1)), pa.array([*total.ravel().astype(np.int64).tolist(), n])], names=["cell", "n"])

    got = dict(fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect())
    return got.get(BITS * BITS, 0), np.array([got.get(i, 0) for i in range(BITS * BITS)], dtype=float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to `parts` partitions of near-equal width, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - k)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        while len(group) < width:
            group.append(max((b for b in left if b not in group), key=lambda b: (corr[b, group].mean(), -b)))
        left = [b for b in left if b not in group]
        groups.append(sorted(group))
    return groups


def threshold_costs(n: int, p: np.ndarray, group: list[int], radius: int) -> dict[int, float]:
    """Estimated work of each threshold: probe keys, and candidates by the chance that two fingerprints are so close in the group."""
    chance = np.zeros(radius + 1)
    chance[0] = 1.0
    for b in group:
        same = p[b] ** 2 + (1 - p[b]) ** 2
        chance = chance * same + np.concatenate(([0], chance[:-1])) * (1 - same)
    cost = {-1: 0.0}
    for t in range(radius + 1):
        keys = sum(comb(len(group), e) for e in range(t + 1)) + (t > 0)
        cost[t] = n * keys + 0.2 * n * n * float(chance[: t + 1].sum()) / 2
    return cost


def allot(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Dynamic programming over partitions: the thresholds that sum to `total` at least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for t, c in cost.items():
                if used + t not in nxt or spent + c < nxt[used + t][0]:
                    nxt[used + t] = (spent + c, [*chosen, t])
        best = nxt
    return best[total]


def plan(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, for the number of partitions with the least estimated work."""
    p = np.diag(both) / max(n, 1)
    found = []
    for parts in range(1, radius + 3):
        groups = group_bits(n, both, parts)
        spent, chosen = allot([threshold_costs(n, p, g, radius) for g in groups], radius - parts + 1)
        found.append((spent, parts, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flips(bits: list[int], most: int) -> list[int]:
    """Masks of one to `most` (2 at most) of these bits."""
    one = [1 << b for b in bits] if most >= 1 else []
    return one + [a | b for i, a in enumerate(one) for b in one[i + 1 :]] if most >= 2 else one


def links(nodes: DataFrame, radius: int = 2, bucket_cap: int = 256) -> DataFrame:
    """Edges (u < v) between rows of nodes (fp, node; fp unique) that connect just what lies within `radius` (1 or 2) bits."""
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    spark = nodes.sparkSession
    n, both = bit_agreement(nodes)
    if n < 2:
        return spark.createDataFrame([], "u long, v long")
    rows = []
    for i, (bits, t) in enumerate(plan(n, both, radius)):
        mask = sum(1 << b for b in bits)
        own = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        rows.append(F.array(F.struct(F.lit(i).alias("part"), own.alias("key"), F.lit(True).alias("data"))))
        if t:
            masks = F.array(*[F.lit(signed(m)) for m in flips(bits, t)])
            rows.append(F.transform(masks, lambda m, own=own, i=i: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(m).alias("key"), F.lit(False).alias("data"))))
    keys = nodes.select("fp", "node", F.inline(F.concat(*rows)))
    sizes = keys.groupBy("part", "key").agg(F.count_if("data").alias("n"))
    hot = checkpoint(sizes.filter(F.col("n") > bucket_cap).select("part", "key"))
    n_hot = hot.count()
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    rest = keys
    if n_hot:
        side = F.broadcast(hot) if n_hot <= 10_000 else hot
        rest = keys.join(side, ["part", "key"], "left_anti")
    a, b = rest.alias("a"), rest.filter("data").alias("b")
    on = [F.col("a.part") == F.col("b.part"), F.col("a.key") == F.col("b.key"), F.col("a.fp") < F.col("b.fp"), near]
    edges = a.join(b, reduce(lambda x, y: x & y, on)).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
    if n_hot:
        members = keys.join(side, ["part", "key"], "left_semi").groupBy("fp").agg(F.min("node").alias("node"))
        one = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << x)) for x in range(BITS if radius == 2 else 0)])
        if radius == 1:
            # within one bit: equal keys after clearing one bit
            met = members.select("node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(~(1 << x) & (1 << 64) - 1))) for x in range(BITS)])).alias("bit", "key"))
            w = Window.partitionBy("bit", "key")
        else:
            met = members.select("node", F.explode(F.transform(one, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
            w = Window.partitionBy("key")
        star = met.withColumn("u", F.min("node").over(w)).filter("u < node").select("u", F.col("node").alias("v"))
        edges = edges.unionByName(star)
    return edges.distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest member) for every end of the edges (u, v): alternating large-star and small-star steps.

    Each step keeps the components and draws members towards their minimum; the edges are written to the shared
    folder each round and only a count and a checksum reach the driver.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = checkpoint(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("x")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(least, F.col("u") == F.col("x"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = checkpoint(small.filter("u != v").distinct())
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2, bucket_cap: int = 256) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of `radius` bits or fewer)."""
    fps = checkpoint(fingerprints(docs, id_col, text_col, shingle, seed))
    nodes = checkpoint(fps.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")))
    comps = connected_components(links(nodes, radius, bucket_cap))
    found = checkpoint(nodes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return fps.join(found, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
