"""Alarms of runs that take too long, raised while they go on: as keyed state of a stream of events, or by a timer beside a call."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strophe.plans.request import Request

#: Minutes that a run may take, for the run itself and for its parts, and what they are multiplied with. Fixed values.
BASE, TIMESTAMPS, TRAINING, RECOGNITION = 10.0, 20.0, 240.0, 20.0
PATIENCE, QUEUE_PATIENCE = 2.0, 0.3


def minutes_allowed(timestamps: bool, training: bool, recognition: bool, by_queue: bool) -> float:
    total = BASE + TIMESTAMPS * timestamps + TRAINING * training + RECOGNITION * recognition
    return total * (QUEUE_PATIENCE if by_queue else PATIENCE)


def minutes_of(request: Request) -> float:
    """The minutes that a request may take; requests ask for neither training nor recognition."""
    return minutes_allowed(request.timestamps != "none", False, False, any("sqs/" in a for a in request.notify))


@contextmanager
def alarmed(minutes: float, tell: Callable[[float], object]) -> Iterator[None]:
    """Calls tell(minutes) once if what is inside is not done after so many minutes; it goes on."""
    timer = threading.Timer(minutes * 60, tell, [minutes])
    timer.daemon = True
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def late_runs(events: DataFrame) -> DataFrame:
    """run, minutes of every run that has not ended in time, once each, as soon as its time is over.

    events (a stream): run, kind ("start" or "end"), minutes (the time allowed, on the start). The state of a run is its
    allowance until it ends or its alarm is raised; an end before its start, or a second start, is taken as it comes: a
    run that has ended raises nothing.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            minutes = state.get[0]
            state.remove()
            yield pd.DataFrame({"run": [key[0]], "minutes": [minutes]})
            return
        allowed, ended = (state.get[0] if state.exists else None), False
        for pdf in frames:
            ended |= bool((pdf["kind"] == "end").any())
            starts = pdf.loc[pdf["kind"] == "start", "minutes"].dropna()
            if allowed is None and len(starts):
                allowed = float(starts.iloc[0])
        if ended and state.exists:
            state.remove()
        elif allowed is not None and not ended and not state.exists:
            state.update((allowed,))
            state.setTimeoutDuration(max(1, int(allowed * 60_000)))
        elif state.exists:
            state.setTimeoutDuration(max(1, int(allowed * 60_000)))
        yield pd.DataFrame({"run": pd.Series([], dtype="object"), "minutes": pd.Series([], dtype="float64")})

    rows = events.select(F.col("run").cast("string"), F.col("kind").cast("string"), F.col("minutes").cast("double"))
    return rows.groupBy("run").applyInPandasWithState(update, "run string, minutes double", "minutes double", "append", GroupStateTimeout.ProcessingTimeTimeout)
