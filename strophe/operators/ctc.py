"""Alignment of known labels to frames, and long recordings in windows.

A recording's frames are log probabilities of labels. Alignment is the best path through the labels with blanks
between them (each label once at least, a blank between equal ones); rows of one shape share the arrays of a batch.
Windows with context are dealt as rows, so that no task sees more of a recording than a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames whose steps are kept at a time on the way back; before that only the scores at every such frame are kept.
BLOCK = 512
STEPS = 3


def log_softmax(frame: Column) -> Column:
    """The log probabilities of one frame's scores, without overflow."""
    top = F.array_max(frame)
    total = F.aggregate(frame, F.lit(0.0), lambda a, x: a + F.exp((x - top).cast("double")))
    return F.transform(frame, lambda x: (x - top).cast("double") - F.ln(total))


def states_of(labels: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Blanks and labels in turn, for rows of labels, and where two states may be passed at once: to a label unlike the one before."""
    rows, n = labels.shape
    states = np.full((rows, 2 * n + 1), blank, np.int64)
    states[:, 1::2] = labels
    jump = np.zeros(states.shape, bool)
    jump[:, 3::2] = labels[:, 1:] != labels[:, :-1]
    return states, jump


def advance(score: np.ndarray, frame: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores after a frame, and the number of states passed; of equals the fewest."""
    came = np.full((STEPS, *score.shape), -np.inf)
    came[0] = score
    came[1, :, 1:] = score[:, :-1]
    came[2, :, 2:] = np.where(jump[:, 2:], score[:, :-2], -np.inf)
    step = came.argmax(axis=0)
    return came.max(axis=0) + frame, step.astype(np.uint8)


def best_paths(frames: np.ndarray, labels: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores (-inf where there is no path) and states by frame of the best paths. frames: rows x time x labels; labels: rows x n."""
    rows, time, _ = frames.shape
    states, jump = states_of(labels, blank)
    size = states.shape[1]
    emitted = [np.take_along_axis(frames[:, t], states, axis=1) for t in range(time)] if time <= BLOCK else None

    def at(t: int) -> np.ndarray:
        return emitted[t] if emitted is not None else np.take_along_axis(frames[:, t], states, axis=1)

    score = np.full((rows, size), -np.inf)
    score[:, :2] = at(0)[:, :2]
    kept = [score]
    for t in range(1, time):
        score, _ = advance(score, at(t), jump)
        if t % BLOCK == 0:
            kept.append(score)
    last = np.full(rows, size - 1)
    if size > 1:
        last -= score[:, -1] <= score[:, -2]
    total = score[np.arange(rows), last]
    path = np.zeros((rows, time), np.int64)
    path[:, -1] = last
    for block in range((time - 1) // BLOCK, -1, -1):
        first, stop = block * BLOCK, min((block + 1) * BLOCK, time - 1)
        score, steps = kept[block], []
        for t in range(first + 1, stop + 1):
            score, step = advance(score, at(t), jump)
            steps.append(step)
        for t in range(stop, first, -1):
            path[:, t - 1] = path[:, t] - steps[t - first - 1][np.arange(rows), path[:, t]]
    return total, path


def spans(frames: np.ndarray, labels: np.ndarray, path: np.ndarray) -> list[dict]:
    """Label, first frame, frame after the last and mean probability of each label of one path."""
    out = []
    for i, label in enumerate(labels.tolist()):
        on = np.flatnonzero(path == 2 * i + 1)
        out.append({"label": label, "start": int(on[0]), "stop": int(on[-1]) + 1, "score": float(np.exp(frames[on, label]).mean())})
    return out


SPAN = "array<struct<label: int, start: int, stop: int, score: double>>"


def forced_align(df: DataFrame, key: str, frames: str, labels: str, blank: int = 0) -> DataFrame:
    """key, score, path (a label a frame), spans of every row: frames (array of arrays of log probabilities) with the known labels.

    Null labels are none, and null frames are no frames. A row that has no path (too few frames, a label that is the
    blank or unknown, frames of different widths or with nulls) has null in score and path and no spans; no frames and
    no labels have score 0 and an empty path.
    """
    kind = df.schema[key].dataType.simpleString()
    span_type = pa.list_(pa.struct([("label", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            score, path, found = [None] * n, [None] * n, [[] for _ in range(n)]
            shapes: dict[tuple[int, int, int], list[int]] = {}
            given, known = batch.column("frames").to_pylist(), [x or [] for x in batch.column("labels").to_pylist()]
            for i, (f, own) in enumerate(zip(given, known, strict=True)):
                widths = {len(x) if x is not None and None not in x else -1 for x in f or []}
                if not f and not own:
                    score[i], path[i] = 0.0, []
                elif len(widths) == 1 and max(widths) > blank and all(x is not None and 0 <= x < max(widths) and x != blank for x in own):
                    shapes.setdefault((len(f), len(own), max(widths)), []).append(i)
            for (_, _, _), rows in shapes.items():
                x, y = np.array([given[i] for i in rows], float), np.array([known[i] for i in rows], np.int64).reshape(len(rows), -1)
                total, states = best_paths(x, y, blank)
                for k, i in enumerate(rows):
                    if total[k] > -np.inf:
                        own = np.where(states[k] % 2, np.append(y[k], blank)[np.minimum(states[k] // 2, y.shape[1])], blank)
                        score[i], path[i], found[i] = float(total[k]), own.tolist(), spans(x[k], y[k], states[k])
            columns = [batch.column("key"), pa.array(score, pa.float64()), pa.array(path, pa.list_(pa.int32())), pa.array(found, span_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "score", "path", "spans"])

    rows = df.select(F.col(key).alias("key"), F.col(frames).cast("array<array<double>>").alias("frames"), F.col(labels).cast("array<int>").alias("labels"))
    return rows.mapInArrow(run, f"{key} {kind}, score double, path array<int>, spans {SPAN}")


def window_plan(df: DataFrame, key: str, seconds: str, width: float = 30.0, context: float = 0.1, rate: float = 50.0) -> DataFrame:
    """key, window, start, stop (frames that are kept), in_start, in_stop (frames that are read): windows of `width` seconds with `context` of it on both sides, cut at the recording's ends."""
    at = F.col("window") * F.lit(width)
    end = F.col(seconds).cast("double")
    n = F.ceil(end / F.lit(width)).cast("int")
    dealt = df.filter(end > 0).select(key, F.col(seconds), F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))

    def frame(time: Column) -> Column:
        return F.floor(time * F.lit(rate)).cast("long")

    stop = F.least(at + F.lit(width), end)
    return dealt.select(
        key, "window", frame(at).alias("start"), frame(stop).alias("stop"),
        frame(F.greatest(at - F.lit(width * context), F.lit(0.0))).alias("in_start"), frame(F.least(at + F.lit(width * (1 + context)), end)).alias("in_stop"),
    )


def in_windows(frames: DataFrame, key: str, seq: str, value: str, width: int, context: int, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, seq, out (array<double>): `work` over the frames (value: array of numbers) in windows of `width` with `context` frames on both sides.

    seq numbers a recording's frames from 0. Each frame is dealt to its own window and to those whose context it is;
    `work` maps the frames of a window, rows in order, to as many rows; the rows of the context are dropped again. So
    the result is that of the whole recording wherever `work` looks no further than the context. A recording of any
    length is as many tasks as it has windows. Null keys are one recording; frames with a null seq or value take no part.
    """
    kind = frames.schema[key].dataType.simpleString()
    own = F.floor(F.col("seq") / width)
    reach = F.sequence(F.floor((F.col("seq") - context) / width), F.floor((F.col("seq") + context) / width))
    rows = frames.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(value).cast("array<double>").alias("value")).filter("seq is not null and value is not null")
    dealt = rows.select("key", "seq", "value", own.alias("own"), F.explode(reach).alias("window")).filter("window >= 0")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq", ignore_index=True)
        keep = (group["own"] == group["window"]).to_numpy()
        if not keep.any():
            return pd.DataFrame({"key": group["key"].iloc[:0], "seq": group["seq"].iloc[:0], "out": pd.Series([], dtype=object)})
        out = work(np.array(group["value"].tolist(), float))
        return pd.DataFrame({"key": group["key"][keep].to_numpy(), "seq": group["seq"][keep].to_numpy(), "out": list(out[keep])})

    done = dealt.groupBy("key", "window").applyInPandas(run, f"key {kind}, seq long, out array<double>")
    return done.withColumnsRenamed({"key": key, "seq": seq})
