"""Alignment of recognised text with its source, and the guided decoder. Each line is a group of its own."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.functions.diff import edit_script


def assign_text(source: list[tuple[int, str]], heard: str) -> list[tuple[int, str]]:
    """What was heard for each (id, text) of the source: the pieces of an edit script fall to the line they lie in."""
    joined = "".join(t + " " for _, t in source)
    ends, total = [], 0
    for _, t in source:
        total += len(t) + 1
        ends.append(total)
    out, at, line = [""] * len(source), 0, 0
    for op, text in edit_script(joined, heard):
        for c in text:
            while line + 1 < len(ends) and at >= ends[line]:
                line += 1
            if op >= 0:
                out[line] += c
            at += op <= 0
    return [(i, t.strip()) for (i, _), t in zip(source, out, strict=True)]


def align_asr(lines: DataFrame, heard: DataFrame, chapter: str, line: str, text: str) -> DataFrame:
    """line, asr_text: each chapter's recognised text (heard: chapter, heard) dealt to its lines. A chapter is one row, as the script of its differences is one."""
    kind = lines.schema[line].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, spoken in zip(batch.column("source").to_pylist(), batch.column("heard").to_pylist(), strict=True):
                dealt = assign_text([(s["id"], s["text"] or "") for s in source], spoken or "")
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in dealt], batch.schema.field("source").type.value_type.field("id").type), pa.array([t for _, t in dealt], pa.string())], names=[line, "asr_text"])

    chapters = lines.groupBy(chapter).agg(F.sort_array(F.collect_list(F.struct(F.col(line).alias("id"), F.col(text).alias("text")))).alias("source"))
    return chapters.join(heard, chapter, "left").select("source", "heard").mapInArrow(run, f"{line} {kind}, asr_text string")


def splice(text: str, flags: list[bool], heard: str) -> list[tuple[int, str, bool]]:
    """(place, char, is_asr): recognised characters are put in after a character with a flagged gap, and take their place from it."""
    out: list[tuple[int, str, bool]] = []
    at = 0
    for op, piece in edit_script(text, heard):
        for c in piece:
            if op <= 0:
                out.append((at, c, False))
                at += 1
            elif at and flags[at - 1]:
                out.append((at - 1, c, True))
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("ch", T.StringType()), T.StructField("is_asr", T.BooleanType())])))
def splices(text: pa.Array, flags: pa.Array, heard: pa.Array) -> pa.Array:
    """splice of each line; the lines' characters are Python objects one line at a time."""
    ats, chars, added, sizes = array("i"), bytearray(), bytearray(), [0]
    widths = array("i", [0])
    for t, f, h in zip(text, flags, heard, strict=True):
        own = splice(t.as_py() or "", f.as_py() or [], h.as_py() or "")
        sizes.append(sizes[-1] + len(own))
        ats.extend(at for at, _, _ in own)
        added.extend(is_asr for _, _, is_asr in own)
        for _, c, _ in own:
            chars += c.encode()
            widths.append(len(chars))
    columns = [
        pa.Array.from_buffers(pa.int32(), len(ats), [None, pa.py_buffer(ats)]), pa.StringArray.from_buffers(len(ats), pa.py_buffer(widths), pa.py_buffer(chars)),
        pa.array(np.frombuffer(added, np.uint8).astype(bool)),
    ]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, names=["at", "ch", "is_asr"]))


# what makes rows of the arrays is not to ask for them twice
splices = splices.asNondeterministic()


def splice_lines(lines: DataFrame, line: str) -> DataFrame:
    """lines: line, chars (array of ch, begin_ts, end_ts, score, gap, flag in order; ch is one character), heard. Only texts and flags go to Python."""
    def row(step, seq):
        r, added = F.get("chars", step["at"]), step["is_asr"]
        end = r["end_ts"].cast("double")
        return F.struct(
            seq.cast("long").alias("seq"), step["ch"].alias("ch"), F.when(added, end).otherwise(r["begin_ts"].cast("double")).alias("begin_ts"),
            F.when(added, end + r["gap"].cast("double")).otherwise(end).alias("end_ts"), F.when(added, 1.0).otherwise(r["score"].cast("double")).alias("score"), added.alias("is_asr"),
        )

    steps = lines.select(line, "chars", splices(F.array_join("chars.ch", ""), "chars.flag", "heard").alias("steps"))
    # rows are made before they are dealt out, or each would carry its line's characters
    return steps.select(line, F.transform("steps", row).alias("rows")).select(line, F.inline("rows"))


def splice_asr(chars: DataFrame, line: str) -> DataFrame:
    """chars: line, seq, ch, begin_ts, end_ts, score, gap, flag, asr_text (of a line's first character; others need none). Tables with a row for each line go to splice_lines."""
    fields = F.struct("seq", "ch", "begin_ts", "end_ts", "score", "gap", "flag")
    lines = chars.groupBy(line).agg(F.sort_array(F.collect_list(fields)).alias("chars"), F.min_by("asr_text", "seq").alias("heard"))
    return splice_lines(lines, line)


def guided_paths(df: DataFrame, key: str, frames: str, expected: list[int], width: int = 8, bonus: float = 1.0) -> DataFrame:
    """key, path: guided_beam of every row's frames (arrays of log probabilities); null frames have an empty path."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [guided_beam(f or [], expected, width, bonus) for f in batch.column("frames").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.int32()))], names=[key, "path"])

    return df.select(F.col(key).alias("key"), F.col(frames).cast("array<array<double>>").alias("frames")).mapInArrow(run, f"{key} {kind}, path array<int>")


def guided_beam(emissions: list[list[float]], expected: list[int], width: int = 8, bonus: float = 1.0) -> list[int]:
    """CTC beam search over log probabilities (label 0 blank) with a bonus for labels that continue the expected ones."""
    beams: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, -math.inf)}

    def plus(a: float, b: float) -> float:
        top = max(a, b)
        return top if top == -math.inf else top + math.log(math.exp(a - top) + math.exp(b - top))

    for frame in emissions:
        nxt: dict[tuple[int, ...], tuple[float, float]] = {}

        def add(prefix, blank, label, nxt=nxt):
            b, n = nxt.get(prefix, (-math.inf, -math.inf))
            nxt[prefix] = (plus(b, blank), plus(n, label))

        for prefix, (blank, label) in beams.items():
            total = plus(blank, label)
            add(prefix, total + frame[0], -math.inf)
            for k in range(1, len(frame)):
                gain = bonus if len(prefix) < len(expected) and expected[len(prefix)] == k else 0.0
                if prefix and prefix[-1] == k:
                    add(prefix, -math.inf, label + frame[k])
                    add((*prefix, k), -math.inf, blank + frame[k] + gain)
                else:
                    add((*prefix, k), -math.inf, total + frame[k] + gain)
        beams = dict(sorted(nxt.items(), key=lambda x: (-plus(*x[1]), x[0]))[:width])
    return list(max(beams, key=lambda p: (plus(*beams[p]), p)))


NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def number_words(n: int) -> str:
    if n < 20:
        return NUMBER_WORDS[n]
    if n < 100:
        return TENS[n // 10] + ("-" + NUMBER_WORDS[n % 10] if n % 10 else "")
    for size, name in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            return f"{number_words(n // size)} {name}" + (" " + number_words(n % size) if n % size else "")
    return ""


@F.pandas_udf(T.StringType())
def spell_numbers(token: pd.Series) -> pd.Series:
    """Tokens of digits, points, commas and hyphens alone as words; one that is no plain number is the word for 0."""
    return token.map(lambda t: t if t is None or not re.fullmatch(r"[0-9.,-]*", t) else number_words(int(t) if re.fullmatch(r"[0-9]{1,15}", t) else 0))
