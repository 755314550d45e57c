"""Whitened principal components of embeddings, from one aggregation over the upper triangle of the covariance.

Entries become integers (floor of `scale` times the entry). The statistics are taken over the different integer vectors,
each once, so copies weigh nothing. Spark sums the vectors exactly; then one generated aggregation has, for every two
dimensions i <= j, the sum of (x_i - m_i) * (x_j - m_j): partial sums in each task, one row of them a task to the last
step. The driver sees these d * (d + 1) / 2 numbers alone, puts the matrix together and has LAPACK take it apart. Above
PAIRS pairs the triangle is summed in several aggregations over the same written vectors.

Defined results: null vectors and those with null or non-finite entries take no part. Where lengths differ, the most
frequent one counts (the longer of equals), and vectors of other lengths take no part; empty vectors neither. A
component whose eigenvalue is not above the precision of the largest has null in `whitened` and does not count in
`identity_error`, as has every component of a single vector; `explained` is null where there is no variance at all.
`deviation` is null where it exceeds a long. Vectors of fewer dimensions than `components` give one row for each
dimension. Null and repeated ids and repeated rows stay, each with its own rows; an empty table gives an empty result;
extra columns are ignored. The sum of a dimension must fit a long (entries up to 2**33 for a million vectors).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import new_folder

#: Sums of one aggregation; 64 dimensions have 2,080.
PAIRS = 4_096


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, x (array<long>) of the rows whose vectors take part."""
    as_double = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), as_double.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))


def dimension(rows: DataFrame) -> int:
    """The most frequent length, the longer of equals; 0 without rows."""
    found = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def entry(i: int) -> Column:
    return F.get("x", F.lit(i))


def sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    row = distinct.agg(F.count("*").alias("n"), *[F.sum(entry(i)).alias(f"s{i}") for i in range(d)]).first()
    return row["n"], [row[f"s{i}"] for i in range(d)]


def triangle(columns: DataFrame, d: int, mean: list[float], n: int) -> np.ndarray:
    """Covariance (divisor n) of columns c0 to c<d-1>: a sum of centred products for each two dimensions."""
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    found = np.zeros((d, d))
    for at in range(0, len(pairs), PAIRS):
        part = pairs[at : at + PAIRS]
        used = sorted({k for p in part for k in p})
        centred = columns.select(*[(F.col(f"c{k}") - F.lit(mean[k])).alias(f"c{k}") for k in used])
        row = centred.selectExpr(*[f"sum(c{i} * c{j}) AS p{i}_{j}" for i, j in part]).first()
        for i, j in part:
            found[i, j] = found[j, i] = row[f"p{i}_{j}"] / n
    return found


def components_of(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and their unit eigenvectors in columns."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def projection(mean: list[float], weights: np.ndarray) -> Column:
    """The sum of the weighted centred entries of x."""
    total = (entry(0) - F.lit(mean[0])) * F.lit(float(weights[0]))
    for i in range(1, len(mean)):
        total = total + (entry(i) - F.lit(mean[i])) * F.lit(float(weights[i]))
    return total


def deviation(n: int, totals: list[int]) -> Column:
    """The sum over the dimensions of (n * x - S) squared, null beyond a long."""
    wide = [F.try_subtract(F.try_multiply(entry(i), F.lit(n).cast("long")), F.lit(s).cast("long")) for i, s in enumerate(totals)]
    squares = [F.try_multiply(w, w) for w in wide]
    while len(squares) > 1:
        squares = [F.try_add(a, b) for a, b in zip(squares[::2], squares[1::2], strict=False)] + squares[len(squares) & ~1 :]
    return squares[0]


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every row that takes part."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, scale)
    d = dimension(rows)
    if d == 0:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = rows.filter(F.size("x") == d)
    folder = new_folder(spark, "vectors")
    rows.select("x").distinct().write.parquet(folder)
    distinct = spark.read.schema("x array<long>").parquet(folder)
    n, totals = sums(distinct, d)
    mean = [s / n for s in totals]
    covariance = triangle(distinct.select(*[entry(i).cast("double").alias(f"c{i}") for i in range(d)]), d, mean, n)
    values, axes = components_of(covariance)
    trace = float(np.trace(covariance))
    k = min(components, d)
    valid = [i for i in range(k) if values[i] > max(values[0], 0.0) * d * np.finfo(float).eps]
    white = {i: projection(mean, axes[:, i] / np.sqrt(values[i])) for i in valid}
    error = None
    if valid:
        scores = distinct.select(*[white[i].alias(f"c{at}") for at, i in enumerate(valid)])
        own = scores.agg(*[F.avg(f"c{at}").alias(f"c{at}") for at in range(len(valid))]).first()
        error = float(np.abs(triangle(scores, len(valid), list(own), n) - np.eye(len(valid))).max())
    parts = [
        F.struct(
            F.lit(i + 1).alias("component"),
            (white[i] if i in white else F.lit(None).cast("double")).alias("whitened"),
            F.lit(float(values[i]) / trace if trace > 0 else None).cast("double").alias("explained"),
        )
        for i in range(k)
    ]
    result = rows.select("vec_id", deviation(n, totals).alias("deviation"), F.inline(F.array(*parts)))
    return result.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))
