"""Ordered analytics: gaps, islands, nearest frames, repairs. Every window has a partition key, so files stay parallel."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.operators import numbering


def lead_gap(df: DataFrame, file: str, order: Sequence[str], begin: str, end: str, durations: DataFrame | None = None) -> DataFrame:
    """Adds gap: time to the next row of the file, at a file's end to its duration (0 where none is known)."""
    w = Window.partitionBy(file).orderBy(*order)
    out = df.withColumn("next_begin", F.lead(begin).over(w))
    last = F.lit(None).cast("double")
    if durations is not None:
        out, last = out.join(durations, file, "left"), F.col("duration")
    return out.withColumn("gap", F.coalesce(F.col("next_begin") - F.col(end), last - F.col(end), F.lit(0.0))).drop("next_begin", "duration")


def outlier_limits(df: DataFrame, cls: str, value: str, sigmas: float = 4.0) -> DataFrame:
    """cls, limit_: mean + sigmas x sample deviation; a class of one row has no limit (null)."""
    return df.groupBy(cls).agg((F.avg(value) + sigmas * F.stddev_samp(value)).alias("limit_"))


def flag_outliers(df: DataFrame, cls: str, value: str, sigmas: float = 4.0) -> DataFrame:
    """Adds is_outlier: value >= its class's limit."""
    return df.join(outlier_limits(df, cls, value, sigmas), cls).withColumn("is_outlier", F.coalesce(F.col(value) >= F.col("limit_"), F.lit(False))).drop("limit_")


def islands(df: DataFrame, file: str, order: Sequence[str], key: str) -> DataFrame:
    """Adds island: number of the run of rows with one key inside a file; the same key later is another run."""
    w = Window.partitionBy(file).orderBy(*order)
    change = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("island", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def midpoint_smooth(df: DataFrame, file: str, order: Sequence[str], begin: str, end: str, duration: Column) -> DataFrame:
    """Neighbours meet half-way; the first starts at 0 and the last ends at the file's duration."""
    w = Window.partitionBy(file).orderBy(*order)
    new_begin = F.coalesce((F.col(begin) + F.lag(end).over(w)) / 2, F.lit(0.0))
    new_end = F.coalesce((F.col(end) + F.lead(begin).over(w)) / 2, duration)
    return df.withColumns({"new_begin": new_begin, "new_end": new_end})


def nearest(points: DataFrame, frames: DataFrame, key: str, t: str, frame_t: str, payload: Sequence[str]) -> DataFrame:
    """For each point the frame of the same key nearest in time, ties to the earlier: one union and two windows, no pairs.

    Frame columns come back under their names; a key without frames gives nulls.
    """
    cols = points.columns
    frame = F.struct(F.col(frame_t), *[F.col(c) for c in payload])
    empty = F.lit(None).cast(frames.select(frame.alias("f")).schema["f"].dataType)
    both = points.select(*cols, F.col(t).alias("_t"), empty.alias("_f"), F.lit(1).alias("_k")).unionByName(
        frames.select(*[(F.col(key) if c == key else F.lit(None)).cast(points.schema[c].dataType).alias(c) for c in cols], F.col(frame_t).alias("_t"), frame.alias("_f"), F.lit(0).alias("_k"))
    )
    before = Window.partitionBy(key).orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy("_t", "_k").rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_p", F.last("_f", True).over(before)).withColumn("_n", F.first("_f", True).over(after)).filter("_k = 1")
    to_prev, to_next = F.col("_t") - F.col(f"_p.{frame_t}"), F.col(f"_n.{frame_t}") - F.col("_t")
    pick = F.when(F.col("_n").isNull() | (to_prev <= to_next), F.col("_p")).otherwise(F.col("_n"))
    return both.withColumn("_b", pick).select(*cols, *[F.col(f"_b.{c}").alias(c) for c in (frame_t, *payload)])


def forward(points: DataFrame, frames: DataFrame, key: str, t: str, frame_t: str, payload: Sequence[str]) -> DataFrame:
    """For each point the first frame of the key at or after it; points past the last frame are not emitted."""
    cols = points.columns
    frame = F.struct(F.col(frame_t), *[F.col(c) for c in payload])
    empty = F.lit(None).cast(frames.select(frame.alias("f")).schema["f"].dataType)
    both = points.select(*cols, F.col(t).alias("_t"), empty.alias("_f"), F.lit(0).alias("_k")).unionByName(
        frames.select(*[(F.col(key) if c == key else F.lit(None)).cast(points.schema[c].dataType).alias(c) for c in cols], F.col(frame_t).alias("_t"), frame.alias("_f"), F.lit(1).alias("_k"))
    )
    w = Window.partitionBy(key).orderBy("_t", "_k").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("_b", F.first("_f", True).over(w)).filter("_k = 0 and _b is not null").select(*cols, *[F.col(f"_b.{c}").alias(c) for c in (frame_t, *payload)])


def word_silence(df: DataFrame, file: str, order: Sequence[str], begin: str, end: str, file_end: str) -> DataFrame:
    """Adds silence: time to the next word; the last word of a file gets the file's end less its own."""
    w = Window.partitionBy(file).orderBy(*order)
    return df.withColumn("silence", F.coalesce(F.lead(begin).over(w) - F.col(end), F.col(file_end) - F.col(end)))


def carry_last(df: DataFrame, file: str, order: Sequence[str], verse: str, silence: str) -> DataFrame:
    """A verse's last silence moves to the next verse's first word when it is larger, and on through verses of one word.

    A run of one-word verses passes the running maximum on, so the cascade is a maximum since the run's start.
    """
    w = Window.partitionBy(file).orderBy(*order)
    first = ~F.lag(verse).over(w).eqNullSafe(F.col(verse)) & F.lag(verse).over(w).isNotNull()
    out = df.withColumn("_first", F.coalesce(first, F.lit(False)))
    # a run: a word and the first words of verses that follow it directly
    out = out.withColumn("_run", F.sum(F.when(F.col("_first"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(file, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("carried", F.max(silence).over(inside)).drop("_first", "_run")


def repair_gaps(df: DataFrame, file: str, order: Sequence[str], begin: str, end: str, missing: float = -1.0) -> DataFrame:
    """A missing begin is the last known end before it, a missing end the next known begin after it."""
    w = Window.partitionBy(file).orderBy(*order)
    known_end = F.last(F.when(F.col(end) != missing, F.col(end)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    known_begin = F.first(F.when(F.col(begin) != missing, F.col(begin)), True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumns({
        "fixed_begin": F.when(F.col(begin) == missing, F.coalesce(known_end, F.lit(0.0))).otherwise(F.col(begin)),
        "fixed_end": F.when(F.col(end) == missing, F.coalesce(known_begin, F.col(end))).otherwise(F.col(end)),
    })


def byte_ranges(df: DataFrame, file: str, offset: str, size: str) -> DataFrame:
    """Adds n_bytes: to the next offset, at the end to the file's size."""
    w = Window.partitionBy(file).orderBy(offset)
    return df.withColumn("n_bytes", F.coalesce(F.lead(offset).over(w), F.col(size)) - F.col(offset))


def order_statistic(df: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """group, value at 0-based position floor(n x share) in ascending order; a share of 1 has no row."""
    return numbering.at_ranks(df, value, lambda n: [F.floor(n * F.lit(share)) + 1], [group]).select(group, value)


def duplicate_suffix(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds unique_name: the name, or where the group has given it away the first free of name + a, b, ... z; none free raises.

    Only where another row of the group is named like a suffixed name ("6a" beside a second "6") does one row's choice
    hang on another's: these groups are folded in order, all others numbered by a window.
    """
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order))
    own = F.col(name).cast("string")
    longer = df.select(*keys, own.alias("_n")).filter(F.col("_n").rlike("[a-z]$")).select(*keys, F.expr("substring(_n, 1, length(_n) - 1)").alias("_short"))
    mixed = longer.join(df.select(*keys, own.alias("_short")), [*keys, "_short"], "left_semi").select(*keys).distinct()
    too_many = F.raise_error(F.concat(F.lit("too many copies of "), own)).cast("string")
    plain = F.when(n == 1, own).when(n <= 27, F.concat(own, F.chr((n + 95).cast("long")))).otherwise(too_many)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, taken, out = pdf.sort_values(list(order)), set(), []
        for value in pdf[name].astype(str):
            free = next((value + c for c in ["", *"abcdefghijklmnopqrstuvwxyz"] if value + c not in taken), None)
            if free is None:
                raise ValueError(f"too many copies of {value}")
            taken.add(free)
            out.append(free)
        return pdf.assign(unique_name=out)

    folded = df.join(mixed, list(keys), "left_semi").groupBy(*keys).applyInPandas(fold, T.StructType([*df.schema.fields, T.StructField("unique_name", T.StringType())]))
    return df.join(mixed, list(keys), "left_anti").withColumn("unique_name", plain).unionByName(folded)


def merge_timestamps(scripts: DataFrame, heard: DataFrame, by: str, verse: str, missing: float = -1.0) -> DataFrame:
    """by, verse, begin_ts, end_ts of both sides in the order of verse numbers, one row a verse; scripts count first.

    Times of `heard` are relative: they start where the row before ends. A script's missing begin or end is taken from
    the heard row of its verse. The running end is the last absolute end plus the relative ends since.
    """
    s = scripts.select(by, verse, F.col("begin_ts").alias("_sb"), F.col("end_ts").alias("_se"), F.lit(True).alias("_s"))
    h = heard.select(by, verse, F.col("begin_ts").alias("_hb"), F.col("end_ts").alias("_he"), F.lit(True).alias("_h"))
    both = s.join(h, [by, verse], "full_outer")
    fixed = F.col("_s").isNotNull() & ((F.col("_se") != missing) | F.col("_h").isNull())
    w = Window.partitionBy(by).orderBy(verse)
    both = both.withColumn("_fixed", fixed).withColumn("_run", F.sum(F.col("_fixed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    both = both.withColumn("_run", F.coalesce("_run", F.lit(0))).withColumn("_base", F.coalesce(F.last(F.when(F.col("_fixed"), F.col("_se")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    inside = Window.partitionBy(by, "_run").orderBy(verse).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_base") + F.coalesce(F.sum(F.when(~F.col("_fixed"), F.col("_he"))).over(inside), F.lit(0.0))
    both = both.withColumn("_at", at)
    begin = F.when(F.col("_s").isNull() | ((F.col("_sb") == missing) & F.col("_h").isNotNull()), F.col("_hb") + F.col("_at")).otherwise(F.col("_sb"))
    return both.select(by, verse, begin.alias("begin_ts"), F.when(F.col("_fixed"), F.col("_se")).otherwise(F.col("_he") + F.col("_at")).alias("end_ts"))


def label_spans(segments: DataFrame, tokens: DataFrame, by: str, blank: str = "<blank>") -> DataFrame:
    """by, token, begin, end of tokens spelled by the labels between blanks, with half of the blank on each side (all of it at both ends).

    segments: by, seg, label, start, stop in order; tokens: by, token (from 0), n_labels. No label repeats across a token's
    end: labels fall to tokens by their running number.
    """
    w = Window.partitionBy(by).orderBy("seg")
    s = segments.select(by, "seg", "label", "start", "stop", *[f(c).over(w).alias(n) for f, c, n in ((F.lag, "label", "_pl"), (F.lag, "start", "_ps"), (F.lag, "stop", "_pe"), (F.lead, "label", "_nl"), (F.lead, "start", "_ns"), (F.lead, "stop", "_ne"))])
    s = s.filter(F.col("label") != blank).withColumn("_i", F.row_number().over(w))
    order = Window.partitionBy(by).orderBy("token")
    t = tokens.withColumn("_last", F.sum("n_labels").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", F.col("_last") - F.col("n_labels") + 1)
    t = t.withColumn("_n", F.max("token").over(Window.partitionBy(by))).filter("n_labels > 0")
    head = s.select(by, F.col("_i").alias("_first"), "start", "_pl", "_ps", "_pe")
    tail = s.select(by, F.col("_i").alias("_last"), "stop", "_nl", "_ns", "_ne")
    both = t.join(head, [by, "_first"]).join(tail, [by, "_last"])
    begin = F.when(F.col("_pl") == blank, F.when(F.col("token") == 0, F.col("_ps")).otherwise(F.floor((F.col("_ps") + F.col("_pe")) / 2))).otherwise(F.col("start"))
    end = F.when(F.col("_nl") == blank, F.when(F.col("token") == F.col("_n"), F.col("_ne")).otherwise(F.floor((F.col("_ns") + F.col("_ne")) / 2))).otherwise(F.col("stop"))
    return both.select(by, "token", begin.cast("long").alias("begin"), end.cast("long").alias("end"))


def spaces_at_word_starts(chars: DataFrame, line: str, order: str, char_seq: str, ch: str) -> DataFrame:
    """line, order, part (0 a space that was put in, 1 a character), ch, score (1 for a space): a space before each word but the line's first."""
    first = F.row_number().over(Window.partitionBy(line).orderBy(order)) == 1
    own = F.struct(F.lit(1).alias("part"), F.col(ch).alias("ch"), F.col("score").alias("score"))
    space = F.struct(F.lit(0).alias("part"), F.lit(" ").alias("ch"), F.lit(1.0).alias("score"))
    return chars.withColumn("_first", first).select(line, order, F.inline(F.when((F.col(char_seq) == 0) & ~F.col("_first"), F.array(space, own)).otherwise(F.array(own))))


def line_groups(df: DataFrame, file: str, order: Sequence[str], starts: Column, text: str) -> DataFrame:
    """file, grp, n_lines, text of each group: a new group where `starts` holds."""
    w = Window.partitionBy(file).orderBy(*order)
    grouped = df.withColumn("grp", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    parts = F.sort_array(F.collect_list(F.struct(*order, text)))
    return grouped.groupBy(file, "grp").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(parts, lambda s: s[text]), " ").alias("grouped_text"))


def number_repeated_keys(df: DataFrame, keys: Sequence[str], verse: str, order: Sequence[str]) -> DataFrame:
    """Adds verse_key and is_error: a second verse "0" of a key becomes "0s"; any other repeated verse is an error."""
    n = F.row_number().over(Window.partitionBy(*keys, verse).orderBy(*order))
    second = (F.col(verse) == "0") & (n == 2)
    return df.withColumn("verse_key", F.when(second, "0s").otherwise(F.col(verse))).withColumn("is_error", (n > 1) & ~second)


def segments_between(df: DataFrame, file: str, order: Sequence[str], t: str, offset: str) -> DataFrame:
    """Adds duration and n_bytes to the next hit of the file; a file's last hit starts no segment."""
    w = Window.partitionBy(file).orderBy(*order)
    out = df.withColumn("duration", F.lead(t).over(w) - F.col(t)).withColumn("n_bytes", F.lead(offset).over(w) - F.col(offset))
    return out.filter("duration is not null")
