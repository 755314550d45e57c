"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

Each source has a repetition rate: its target share of the wanted documents over the documents it has. A document's
uniform number comes from an MD5 of seed and id; the count is the Poisson quantile at that number, so any document
can be redone alone and a re-run gives the same mixture. Documents are exploded by their counts and dealt to
partitions and ordered by a second hash of (seed, id, copy), which is the global shuffle.

Rates are a row for each source; they are broadcast when there are at most `broadcast_sources` of them, else joined on
(source, salt) so that a source with a third of all rows is spread over `salts` keys. A source's distribution has about
as many cells as a document of it gets copies.

Defined results: a null source is a source like any other; a null id draws as the id ''; repeated rows of an id draw
the same count and stay repeated; a source without a weight gets rate 0 and goes; an empty table stays empty. The
documents travel as one value, so no name of theirs can clash; replicate() returns them as they are, and of mix() an
input column named like an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import checkpoint

ADDED = ("copy", "rate", "shuffle_key")


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) with 52 bits from MD5."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rates: DataFrame, *keys: str) -> DataFrame:
    """keys, rate, cdf of rows with a positive rate (the keys are unique): P(X <= 0), P(X <= 1), ... as far as a double can tell from 1."""
    cells = rates.select(*keys, "rate", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))).alias("k"))
    below = Window.partitionBy(*keys).orderBy("k")
    log_p = F.col("k") * F.log("rate") - F.col("rate") - F.sum(F.log(F.greatest("k", F.lit(1)))).over(below)
    sums = cells.withColumn("log_p", log_p).withColumn("p", F.sum(F.exp("log_p")).over(below))
    return sums.groupBy(*keys, "rate").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda c: c["p"]).alias("cdf"))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None, source_col: str = "source") -> DataFrame:
    """source, n, rate. Target weights are those given, or each source's count to the power alpha; `total` documents are wanted (None: as many as there are)."""
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    wanted = F.col("all_n") if total is None else F.lit(total)
    rate = F.col("w") * wanted / F.col("all_w") / F.col("n")
    return weighed.crossJoin(F.broadcast(sums)).select("source", "n", F.when(F.col("all_w") > 0, rate).otherwise(0.0).alias("rate"))


def drawn(docs: DataFrame, weights: dict[str, float] | None, alpha: float, total: int | None, seed: int, id_col: str, source_col: str, broadcast_sources: int, salts: int) -> DataFrame:
    """doc (the document), rate, copy (from 0) and shuffle_key of every copy, in shuffled order."""
    rates = checkpoint(repetition_rates(docs, weights, alpha, total, source_col)).filter("rate > 0")
    cdfs = checkpoint(poisson_cdf(rates.select(F.struct("source").alias("key"), "rate"), "key"))
    own_id = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    # the number is drawn before the join, so it is computed once a row and not for each cell
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.struct(F.col(f"`{source_col}`").alias("source")).alias("key"), own_id.alias("own_id"), uniform(seed, F.col(f"`{id_col}`")).alias("u"))
    if cdfs.count() <= broadcast_sources:
        rated = keyed.join(F.broadcast(cdfs), "key")
    else:
        spread = cdfs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        rated = keyed.withColumn("salt", F.pmod(F.xxhash64("own_id"), F.lit(salts))).join(spread, ["key", "salt"])
    counted = rated.select("doc", "own_id", "rate", F.size(F.filter("cdf", lambda c: c <= F.col("u"))).alias("n")).filter("n > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}:shuffle"), F.col("own_id"), F.col("copy")))
    return copies.select("doc", "rate", "copy", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", broadcast_sources: int = 10_000, salts: int = 64,
) -> DataFrame:
    """The documents' columns, copy (from 0), rate and shuffle_key, in shuffled order."""
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    return drawn(docs, weights, alpha, total, seed, id_col, source_col, broadcast_sources, salts).select(*[F.col(f"doc.`{c}`") for c in kept], *ADDED)


def replicate(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", broadcast_sources: int = 10_000, salts: int = 64,
) -> DataFrame:
    """The documents' own columns alone, whatever their names, one row for each copy, in shuffled order."""
    return drawn(docs, weights, alpha, total, seed, id_col, source_col, broadcast_sources, salts).select("doc.*")
