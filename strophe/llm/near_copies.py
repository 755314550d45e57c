"""Near copies by the Jaccard similarity of word shingles (five words and 80 percent), with SimHash as first proposal.

64 bits cannot tell 0.8 from less without loss at any radius that can be paired, so SimHash only proposes, and whole
shingle sets decide. Every text has the same number of further keys: BANDS digests of ROWS min-hashes each over its
shingles. Two texts of similarity s share one with probability 1 - (1 - s**ROWS)**BANDS: 0.9993 at 0.80, 0.99999 at 0.85;
what a pair fails to share, the links of others mostly connect. Sharing a key only proposes too.

1. Copies (equal words) collapse. SimHash groups give stars (least id, member), and keys give stars from the member
   whose keys have most members in all, the key's centre. These are verified on the whole shingle sets.
2. Keys whose members are still in different components are finished in one round. In one of at most PAIRED members all
   pairs of different components are verified. In a larger one each member is taken as its difference to the centre's
   set: the shingles that only one of the two has. For similar members x and y at most (|x| + |y|) / 9 shingles (at 0.8)
   lie in one of their differences alone, so what both differences share has a least size, and the first shared one
   stands among the first few of each, in any order that both follow: shingles that the centre lacks, from
   the rarest among its members to the most frequent, then those that it has. Members near the centre are linked with it at once, so only pairs with one far from it are wanted;
   pairs are made of those that meet in such a shingle, early enough to share as many as they must. Every pair of a key
   that may be similar was verified or lies in one component then; variants of one text that are no near copies of each
   other have keys in common, but no such shingles, and their pairs are never made.

Pairs whose sizes rule out the similarity are not made, nor those of more than FAR differing SimHash bits (at 0.8 the
mean is 10 and the deviation 3) unless one set is smaller than FEW; differences need no SimHash. Each text travels to
its verification once for each pair at most, and once for each centre of a large key, compressed.

Shingles are equal when their 64-bit hashes are. Defined results: null text counts as empty; a text of fewer words than a
shingle is one shingle; null ids take no part; rows of one id are one node.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.lineage import Written
from strophe.llm.common import slices, text_rows
from strophe.llm.simhash import connected_components, links, majority, shingle_hashes

#: Keys of a text and min-hashes in each; SimHash bits beyond which two texts are not compared, and the set size from which that holds.
BANDS, ROWS, FAR, FEW = 24, 6, 22, 20
#: Members of a key that are paired as they are, at most.
PAIRED = 16
#: Ids that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST = 1_000_000


def band_keys(hashes: np.ndarray, seed: int) -> np.ndarray:
    """The BANDS keys of a set of 64-bit hashes."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1 << 62, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = rng.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4_096):
        least = np.minimum(least, ((hashes[at : at + 4_096] ^ flips) * factors).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def profiles(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """doc_id, tag (digest of the words), fp (SimHash), n (different shingles), keys."""

    def run(batches):
        for batch in slices(batches):
            tags, fps, sizes, keys = [], [], [], []
            for t in batch.column("text").cast(pa.binary()):
                words = t.as_py().lower().split()
                hashes = shingle_hashes(words, shingle, seed)
                own = np.unique(hashes)
                tags.append(xxhash.xxh3_128_digest(b" ".join(words), seed))
                fps.append(majority(hashes))
                sizes.append(len(own))
                keys.append(band_keys(own, seed))
            columns = [batch.column("doc_id"), pa.array(tags, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "fp", "n", "keys"])

    return rows.mapInArrow(run, "doc_id long, tag binary, fp long, n long, keys array<long>")


def packed_texts(rows: DataFrame) -> DataFrame:
    """doc_id and the different texts of its rows, compressed: a third of the size of their shingles' hashes."""

    def run(batches):
        for batch in slices(batches):
            found = [zlib.compress(b" ".join(t.as_py().lower().split()), 6) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "own"])

    return rows.mapInArrow(run, "doc_id long, own binary").groupBy("doc_id").agg(F.collect_set("own").alias("texts"))


def shingle_set(packed: bytes, shingle: int, seed: int) -> np.ndarray:
    return np.unique(shingle_hashes(zlib.decompress(packed).split(), shingle, seed))


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs with the texts a of u and b of v."""
    both = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("texts").alias("b")), "v")
    return both.join(texts.select(F.col("doc_id").alias("u"), F.col("texts").alias("a")), "u")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, seed: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""

    def sets(packed) -> list[np.ndarray]:
        return [shingle_set(t, shingle, seed) for t in packed]

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        return len(np.intersect1d(x, y, assume_unique=True)) * (100 + percent) >= (len(x) + len(y)) * percent

    def run(batches):
        last, own = None, []
        for batch in batches:
            us, vs, a, b = (batch.column(c) for c in ("u", "v", "a", "b"))
            keep = np.zeros(batch.num_rows, bool)
            for i, u in enumerate(us.to_pylist()):
                if u != last:
                    last, own = u, sets(a[i].as_py())
                keep[i] = any(similar(x, y) for y in sets(b[i].as_py()) for x in own)
            yield pa.RecordBatch.from_arrays([us.filter(pa.array(keep)), vs.filter(pa.array(keep))], names=["u", "v"])

    return with_texts(pairs, texts).select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def differences(refs: DataFrame, texts: DataFrame, shingle: int, seed: int, percent: int) -> DataFrame:
    """For refs (u, v, part), a row for each text of v (its number k): whether it is near u's first text, its shingles n,
    size e of the difference, its shingles own (first the fresh ones that u lacks, in any order, then others as far as
    wanted), and among how many first ones of it, in an order by u, it shares one with any similar text: probe if that is
    not near u's, and most if it is.
    """
    schema = "u long, v long, k long, part long, near boolean, n long, e long, fresh long, probe long, most long, own array<long>"

    def run(batches):
        last, own = None, None
        for batch in batches:
            rows = []
            for u, v, part, a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "part")), batch.column("a"), batch.column("b"), strict=True):
                if u != last:
                    last, own = u, shingle_set(min(a.as_py()), shingle, seed)
                for k, packed in enumerate(sorted(b.as_py())):
                    y = shingle_set(packed, shingle, seed)
                    new, gone = np.setdiff1d(y, own, assume_unique=True).view(np.int64), np.sort(np.setdiff1d(own, y, assume_unique=True).view(np.int64))
                    n, e = len(y), len(new) + len(gone)
                    near = e * (100 + percent) <= (n + len(own)) * (100 - percent)
                    # two similar texts differ by n * (100 - percent) / percent shingles at most, and one of the two has a difference to u of more than near allows
                    most = n * (100 - percent) // percent + 1
                    probe = max(0, min(most, (e * (100 + percent) + (n - len(own)) * (100 - percent)) // (2 * (100 + percent)) + 1))
                    wanted = max(0, (min(probe, most) if near else most) - len(new))
                    rows.append((u, v, k, part, near, n, e, len(new), probe, most, np.concatenate((new, gone[:wanted]))))
            columns = list(zip(*rows, strict=True)) or [()] * 11
            types = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 5 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["u", "v", "k", "part", "near", "n", "e", "fresh", "probe", "most", "own"])

    return with_texts(refs, texts).select("u", "v", "part", "a", "b").mapInArrow(run, schema)


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ids; few ids are broadcast, so that no text is shuffled that is not wanted."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "doc_id", "left_semi")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()


def may_match(a: str, b: str, percent: int) -> str:
    """SQL condition on the sizes and SimHashes of two sides."""
    return (
        f"n{a} * 100 >= n{b} * {percent} and n{b} * 100 >= n{a} * {percent} and (bit_count(fp{a} ^ fp{b}) <= {FAR} or least(n{a}, n{b}) < {FEW})"
    )


def renamed(df: DataFrame, suffix: str, *more: str) -> DataFrame:
    return df.select(*more, F.col("node").alias(suffix), F.col("n").alias(f"n{suffix}"), F.col("fp").alias(f"fp{suffix}"))


def apart(members: DataFrame) -> DataFrame:
    """Members of keys whose members lie in more than one part, with the number m of the key's members."""
    keys = members.groupBy("key").agg(F.min("part").alias("first"), F.max("part").alias("last"), F.count("*").alias("m"))
    return members.join(keys.filter("first < last").select("key", "m"), "key")


def key_pairs(members: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of members of a key that lie in different parts and may match, but for those with the centre."""
    a = renamed(members.filter("not centre"), "x", F.col("key").alias("kx"), F.col("part").alias("px"))
    b = renamed(members.filter("not centre"), "y", F.col("key").alias("ky"), F.col("part").alias("py"))
    met = a.join(b, F.expr(f"kx = ky and px != py and x < y and {may_match('x', 'y', percent)}"))
    return met.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()


def first_shingles(rows: DataFrame) -> DataFrame:
    """Of rows as differences() gives them, the shingles (own, at the place at from 0) among which similar ones share one; those of one text alone are left out."""
    each = rows.select(*[c for c in rows.columns if c != "own"], F.posexplode("own").alias("i", "own"))
    counted = each.join(each.groupBy("u", "own").agg(F.count("*").alias("c")), ["u", "own"])
    placed = counted.withColumn("at", F.row_number().over(Window.partitionBy("u", "v", "k").orderBy(F.col("i") >= F.col("fresh"), F.when(F.col("i") < F.col("fresh"), F.col("c")), "own")) - 1)
    return placed.filter("c > 1 and at < if(near, least(probe, most), most)").select("u", "v", "part", "near", "n", "e", "probe", "at", "own")


def difference_pairs(firsts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of different parts, not both near their centre, whose differences may have enough in common."""
    a, b = (firsts.select(*[F.col(c).alias(f"{c}_{side}") for c in firsts.columns]) for side in "xy")
    met = a.filter("at_x < probe_x").join(
        b.filter("not near_y"),
        F.expr(
            "u_x = u_y and own_x = own_y and part_x != part_y and (near_x or (at_y < probe_y and v_x < v_y))"
            f" and n_x * 100 >= n_y * {percent} and n_y * 100 >= n_x * {percent}"
            # what stands from the shared one on must hold as many as two similar ones share
            f" and 2 * {100 + percent} * least(e_x - at_x, e_y - at_y) >= {100 + percent} * (e_x + e_y) - {100 - percent} * (n_x + n_y)"
        ),
    )
    return met.select(F.least("v_x", "v_y").alias("u"), F.greatest("v_x", "v_y").alias("v")).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over pairs of `percent` similarity or more) of every row with an id."""
    rows = text_rows(docs, id_col, text_col).filter("doc_id is not null")
    own = Written(profiles(rows, shingle, seed), "profiles").df
    nodes = Written(own.groupBy("tag").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes").df
    prints = Written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "prints").df
    groups = connected_components(links(prints)).withColumnRenamed("node", "first")
    proposed = nodes.select("fp", F.col("node").alias("v")).join(prints.withColumnRenamed("node", "first"), "fp").join(groups, "first", "left")
    proposed = proposed.select(F.coalesce("component", "first").alias("u"), "v").filter("u < v")

    keys = nodes.select("node", "n", "fp", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    met = Written(keys.join(shared, "key"), "met")
    # the node that shares most is in a key the likeliest to be what the others were copied from
    weights = met.df.groupBy("node").agg(F.sum("m").alias("weight"))
    centres = met.df.join(weights, "node").groupBy("key").agg(F.max_by(F.struct("node", "n", "fp"), F.struct("weight", -F.col("node"))).alias("c"))
    centres = Written(centres.select("key", F.col("c.node").alias("u"), F.col("c.n").alias("nu"), F.col("c.fp").alias("fpu")), "centres")
    around = met.df.select("key", "node", "n", "fp").join(centres.df, "key")
    stars = around.filter("u != node").select("u", "nu", "fpu", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("fp").alias("fpv")).filter(may_match("u", "v", percent))
    stars = Written(proposed.unionByName(stars.select("u", "v")).distinct(), "stars")
    edges = verified(stars.df, packed_texts(among(rows, ends(stars.df))), shingle, seed, percent)
    labels = Written(connected_components(edges), "labels")
    centre = F.expr("node = u and n = nu and fp = fpu")
    parted = around.select("key", "node", "n", "fp", "u", centre.alias("centre")).join(labels.df, "node", "left").withColumn("part", F.coalesce("component", "node"))
    members = Written(apart(parted.drop("component")), "members")
    for old in (met, centres, stars):
        old.drop()

    refs = Written(members.df.filter(F.col("m") > PAIRED).select("u", F.col("node").alias("v"), "part").distinct(), "refs")
    far = Written(differences(refs.df, packed_texts(among(rows, ends(refs.df))), shingle, seed, percent), "differences")
    firsts = Written(first_shingles(far.df), "firsts")
    pairs = Written(key_pairs(members.df.filter(F.col("m") <= PAIRED), percent).union(difference_pairs(firsts.df, percent)).distinct(), "pairs")
    edges = verified(pairs.df, packed_texts(among(rows, ends(pairs.df))), shingle, seed, percent).union(far.df.filter("near").select("u", "v"))
    part_of = members.df.select("node", "part").distinct()
    between = edges.join(part_of.toDF("u", "pu"), "u").join(part_of.toDF("v", "pv"), "v")
    merged = Written(connected_components(between.select(F.col("pu").alias("u"), F.col("pv").alias("v"))).select(F.col("node").alias("part"), F.col("component").alias("to")), "merged")
    known = labels.df.unionByName(merged.df.join(labels.df.select(F.col("node").alias("part")), "part", "left_anti").select(F.col("part").alias("node"), F.col("part").alias("component")))
    after = Written(known.join(merged.df, F.col("component") == F.col("part"), "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    for old in (labels, members, refs, far, firsts, pairs, merged):
        old.drop()
    labels = after
    tagged = nodes.join(labels.df, "node", "left").select("tag", F.coalesce("component", "node").alias("component_id"))
    return own.select("doc_id", "tag").join(tagged, "tag").select("doc_id", "component_id")
