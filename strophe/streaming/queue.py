"""A queue of request files as a stream, and windowed counts, sessions and duplicates over event streams."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import nullcontext
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strophe.plans.request import Request, RequestError, decode
from strophe.streaming.alarm import alarmed, minutes_of


def serve(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, work: Callable[[Request], object], every: str = "10 seconds", once: bool = False, late: Callable[[Request, float], object] | None = None, allowed: Callable[[Request], float] = minutes_of) -> StreamingQuery:
    """Run request files (JSON) one at a time, oldest first; a row (request, status, message) for each goes to the outbox.

    late(request, minutes) is called while a request still runs after the minutes that it is allowed.

    The status file is named by the request's hash, so a batch that is repeated after a failure writes the same rows.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", 1).load(inbox)

    def handle(batch: DataFrame, _: int) -> None:
        for row in batch.limit(1).collect():  # one request file in each batch
            status, message = "success", ""
            try:
                request = decode(json.loads(row["value"]))
                with alarmed(allowed(request), partial(late, request)) if late else nullcontext():
                    work(request)
            except (RequestError, ValueError, KeyError) as e:
                status, message = "failed", str(e)
            key = spark.sql("SELECT sha2(:v, 256)", args={"v": row["value"]}).first()[0]
            spark.createDataFrame([(row["value"], status, message)], "request string, status string, message string").coalesce(1).write.mode("overwrite").json(f"{outbox}/{key}")

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """start, event_type, n, total: counts by window of event time; later rows than `late` are dropped by the watermark."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_gaps(events: DataFrame) -> DataFrame:
    """user_id, n, longest_gap (seconds) so far, kept as state for each user."""

    def update(key, frames, state: GroupState):
        n, longest, last = state.get if state.exists else (0, 0.0, 0.0)
        for pdf in frames:
            for t in sorted(pdf["ts"].astype("int64") / 1e9):
                longest = max(longest, t - last) if n else 0.0
                n, last = n + 1, max(last, t)
        state.update((n, longest, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "longest_gap": [longest]})

    return events.select("user_id", "ts").groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, longest_gap double", "n long, longest double, last double", "update", GroupStateTimeout.NoTimeout)
