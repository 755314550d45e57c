"""greedy_decode takes one number a row to its window, with the results of the array form."""

from pyspark.sql import functions as F

from strophe.functions import numbers as nx
from strophe.queries import scores

DIR = "/root/testdata/sf0.001"


def test_greedy_decode_collects_no_vectors(spark):
    frames = spark.read.parquet(f"{DIR}/embeddings.parquet").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("f"))
    want = {r["label"]: r["path"] for r in frames.select("label", nx.greedy_path(F.transform("f", lambda s: s["embedding"])).alias("path")).collect()}
    got = scores.greedy_decode(spark, DIR)
    assert {r["label"]: r["path"] for r in got.collect()} == want and want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "embedding" not in plan.split("Window", 1)[0]
