"""Numbers and places over ranges against plain Python, with nulls, ties and a hot key; no window sees a whole table."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strophe.operators import joins, numbering, ordered, stats


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(rng.choice([None, "a", "b"] + ["hot"] * 5), rng.choice([None, *range(40)]), i) for i in range(3_000)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, id int").repartition(6)


def lowest(x):
    return (x is not None, x)


def test_numbers(df, rows):
    got = {r["id"]: r["n"] for r in numbering.number(df, ["v", "id"], "n").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [r[2] for r in sorted(rows, key=lambda r: (lowest(r[1]), r[2]))]
    assert sorted(got.values()) == list(range(1, len(rows) + 1))
    by_key = {r["id"]: r["n"] for r in numbering.number(df, ["v", "id"], "n", keys=["k"], start=0).collect()}
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (lowest(r[1]), r[2])):
        groups[r[0]].append(r[2])
    assert by_key == {i: n for ids in groups.values() for n, i in enumerate(ids)}
    assert numbering.number(df.limit(0), ["v"], "n").collect() == [] and numbering.number(df.limit(0), ["v"], "n", keys=["k"]).columns == ["k", "v", "id", "n"]


def test_a_hot_key_is_many_ranges(df):
    plan = numbering.number(df, ["v", "id"], "n", keys=["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_quantiles(df, rows):
    shares = (0.0, 0.1, 0.5, 0.999, 1.0)
    for by in ([], ["k"]):
        got = {(r["k"] if by else "", r["p"]): r["q"] for r in stats.quantiles(df, "v", shares, by).collect()}
        groups = defaultdict(list)
        for k, v, _ in rows:
            groups[k if by else ""].append(v)
        for g, values in groups.items():
            known = sorted(v for v in values if v is not None)
            for p in shares:
                assert got[g, p] == known[max(1, math.ceil(round(p * len(known), 9))) - 1]
        assert len(got) == len(groups) * len(shares)
    void = df.withColumn("v", F.lit(None).cast("int")).limit(3)
    assert [r["q"] for r in stats.quantiles(void, "v", [0.5]).collect()] == [None]
    assert [r["q"] for r in stats.quantiles(df.limit(0), "v", [0.5]).collect()] == [None]


def test_order_statistic(df, rows):
    groups = defaultdict(list)
    for k, v, _ in rows:
        groups[k].append(v)
    for share in (0.0, 0.1, 0.77):
        got = {r["k"]: r["v"] for r in ordered.order_statistic(df, "k", "v", share).collect()}
        assert got == {k: sorted(v, key=lowest)[math.floor(len(v) * share)] for k, v in groups.items()}
    assert ordered.order_statistic(df, "k", "v", 1.0).count() == 0


def test_insert_new(spark, df):
    target = df.select(F.col("id").cast("long").alias("id"), "v")
    new = target.select((F.col("id") % 2 * F.col("id")).alias("id"), "v").withColumn("u", F.monotonically_increasing_id())
    got = joins.insert_new(target, new, "id", ["v", "u"]).collect()
    assert sorted(r["id"] for r in got) == list(range(3_000, 3_000 + 1_500))
    assert [lowest(r["v"]) for r in sorted(got, key=lambda r: r["id"])] == sorted(lowest(r["v"]) for r in got)
    assert joins.insert_new(target.limit(0), new.filter("id = 0").limit(2), "id", ["v", "u"]).count() == 2
