"""Column expressions over scores, times and matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CRITICAL, QUESTION = 1e-4, 1e-3


def neg_log10(score: Column) -> Column:
    """-log10, infinite at 0."""
    return F.when(score > 0, -F.log10(score)).otherwise(F.lit(float("inf")))


def round_ms(seconds: Column) -> Column:
    return F.floor(seconds * 1000 + 0.5) / 1000


def score_class(score: Column) -> Column:
    return F.when(score <= CRITICAL, "critical").when(score <= QUESTION, "question").otherwise("")


def clock(seconds: Column) -> Column:
    """m:ss.sss without padding of the minutes; minutes of 0 are left out."""
    minutes = F.floor(seconds / 60)
    rest = F.format_string("%.3f", seconds - 60 * minutes)
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(":"), rest)).otherwise(rest)


def to_frame(seconds: Column, rate: Column | float) -> Column:
    return F.floor(seconds * rate + 0.5).cast("int")


def frame_slice(matrix: Column, begin: Column, end: Column, rate: float) -> Column:
    """Rows of a matrix between two times; an end of 0 is the matrix's end."""
    first = to_frame(begin, rate)
    last = F.when(end == 0, F.size(matrix)).otherwise(F.least(to_frame(end, rate), F.size(matrix)))
    return F.when(last > first, F.slice(matrix, first + 1, F.greatest(last - first, F.lit(0)))).otherwise(F.slice(matrix, 1, 0))


def pad_to(values: Column, n: Column | int, fill: float = 0.0) -> Column:
    """The array with fill up to n elements."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(n - F.size(values), F.lit(0))))


def greedy_path(emissions: Column) -> Column:
    """Greedy CTC decode: the best label of each frame, runs merged, blank (0) left out."""
    best = F.transform(emissions, lambda frame: F.array_position(frame, F.array_max(frame)) - 1)
    marked = F.transform(best, lambda x, i: F.when((i == 0) | (x != F.get(best, i - 1)), x).otherwise(F.lit(0)))
    return F.filter(marked, lambda x: x != 0)


def pad_mask(values: Column, n: Column | int) -> Column:
    """1 for each element of the padded array: padding is not masked out."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.array_repeat(F.lit(1), F.greatest(F.size(values), n))


def expected_minutes(timestamps: Column, training: Column, speech: Column, queued: Column) -> Column:
    """When a run is over time: its estimate by the work that is asked for, less for runs that a queue waits for."""
    total = F.lit(10.0) + F.when(timestamps, 20.0).otherwise(0.0) + F.when(training, 240.0).otherwise(0.0) + F.when(speech, 20.0).otherwise(0.0)
    return total * F.when(queued, 0.3).otherwise(2.0)


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits with its sign: what is negative and rounds to zero is -0.0, as C's and SQL engines' round has it; Spark's round has 0.0."""
    return F.signum(x) * F.abs(F.round(x, digits))
