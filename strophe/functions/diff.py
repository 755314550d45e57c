"""Character differences and the filter of frequent discrepancies."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from itertools import accumulate, groupby
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.lineage import checkpoint

#: Words that a text is searched for in one pass.
FEW = 200
#: Bits of an edit script's table that are held at once; a larger table is made again in blocks on the way back.
MOST_BITS = 1 << 28
#: Pieces of edit scripts that are Python objects at once.
PIECES = 1 << 16
DIFF_TYPE = "array<struct<op: int, text: string>>"
#: The same type for functions that workers import.
DIFFS = T.ArrayType(T.StructType([T.StructField("op", T.IntegerType()), T.StructField("text", T.StringType())]))


def edit_script(a: str, b: str) -> list[tuple[int, str]]:
    """(op, text) with op -1 delete, 0 equal, 1 insert: a longest common subsequence is kept, deletes come before inserts.

    The subsequence table is one bit vector for each character of b, updated by an addition; the walk back reads single bits.
    Of a table above MOST_BITS only the first vector of each block is kept, and one block is made again at a time.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < min(len(a), len(b)) - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[start : len(a) - tail], b[start : len(b) - tail]
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    mask = (1 << len(x)) - 1
    block = len(y) or 1
    if len(x) * len(y) > MOST_BITS:
        block = isqrt(len(y))

    def further(row: int, part: str) -> list[int]:
        rows = []
        for c in part:
            hit = row & at.get(c, 0)
            row = ((row + hit) | (row - hit)) & mask
            rows.append(row)
        return rows

    befores, rows = [mask], []
    for k in range(0, len(y), block):
        rows = further(befores[-1], y[k : k + block])
        befores.append(rows[-1])
    i, j, steps, k = len(x), len(y), [], max(len(y) - 1, 0) // block
    while i or j:
        if j and (j - 1) // block < k:
            k -= 1
            rows = further(befores[k], y[k * block : (k + 1) * block])
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            steps.append((0, x[i]))
        elif j and (not i or not rows[j - 1 - k * block] >> (i - 1) & 1):
            j -= 1
            steps.append((1, y[j]))
        else:
            i -= 1
            steps.append((-1, x[i]))
    chars = [(0, c) for c in a[:start]] + steps[::-1] + [(0, c) for c in a[len(a) - tail :]]
    out: list[tuple[int, str]] = []
    for equal, run in groupby(chars, key=lambda s: s[0] == 0):
        own = list(run)
        for op in (0,) if equal else (-1, 1):
            text = "".join(c for o, c in own if o == op)
            if text:
                out.append((op, text))
    return out


def packed(a: pa.Array, b: pa.Array, script: Callable[[str, str], list[tuple[int, str]]]) -> pa.Array:
    """The script of each two texts (null counts as empty) as Arrow's array of DIFFS; only PIECES pieces and one script are Python objects at once."""
    ops, texts, sizes = [pa.array([], pa.int32())], [pa.array([], pa.string())], []
    held: list[tuple[int, str]] = []

    def flush():
        ops.append(pa.array([o for o, _ in held], pa.int32()))
        texts.append(pa.array([t for _, t in held], pa.string()))
        held.clear()

    for x, y in zip(a, b, strict=True):
        own = script(x.as_py() or "", y.as_py() or "")
        sizes.append(len(own))
        held += own
        if len(held) >= PIECES:
            flush()
    flush()
    offsets = pa.array(accumulate(sizes, initial=0), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.concat_arrays(ops), pa.concat_arrays(texts)], names=["op", "text"]))


@F.arrow_udf(DIFFS)
def char_diff(a: pa.Array, b: pa.Array) -> pa.Array:
    return packed(a, b, edit_script)


# a filter on what the differences give is not to make them a second time
char_diff = char_diff.asNondeterministic()


def normalizer(form: str):
    """A column function for a Unicode form: nfc, nfd, nfkc, nfkd, or "remove" for marks U+0300 to U+036F gone after nfkd."""
    target = "NFKD" if form == "remove" else form.upper()

    @F.pandas_udf(T.StringType())
    def apply(text: pd.Series) -> pd.Series:
        done = text.map(lambda t: None if t is None else unicodedata.normalize(target, t))
        return done.str.replace("[̀-ͯ]", "", regex=True) if form == "remove" else done

    return apply


def is_match(diffs: Column) -> Column:
    """Only white space is inserted or deleted."""
    return F.forall(diffs, lambda d: (d["op"] == 0) | d["text"].rlike(r"^\s*$"))


def totals(diffs: Column) -> dict[str, Column]:
    """Inserted and deleted characters and the longest run that is not equal."""
    def total(op):
        return F.aggregate(F.filter(diffs, lambda d: d["op"] == op), F.lit(0), lambda acc, d: acc + F.length(d["text"]))

    longest = F.coalesce(F.array_max(F.transform(F.filter(diffs, lambda d: d["op"] != 0), lambda d: F.length(d["text"]))), F.lit(0))
    return {"n_inserted": total(1), "n_deleted": total(-1), "longest": longest}


def error_percent(diffs: Column, base: Column, comp: Column) -> Column:
    """Inserted and deleted characters as a percentage of the mean length of both texts in bytes; null where both are empty."""
    n = totals(diffs)
    length = (F.octet_length(base) + F.octet_length(comp)) / 2
    return F.when(length > 0, (n["n_inserted"] + n["n_deleted"]) * 100 / length)


def html(diffs: Column) -> Column:
    def tag(d):
        safe = F.replace(F.replace(F.replace(d["text"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.when(d["op"] == 0, safe).when(d["op"] < 0, F.concat(F.lit("<del>"), safe, F.lit("</del>"))).otherwise(F.concat(F.lit("<ins>"), safe, F.lit("</ins>")))

    return F.array_join(F.transform(diffs, tag), "")


def runs(pairs: DataFrame, key: str, diffs: str = "diffs") -> DataFrame:
    """key, run, pos, op, text of each difference; pieces that are not equal and touch share a run number."""
    pieces = pairs.select(key, F.posexplode(diffs).alias("pos", "d")).select(key, "pos", "d.op", "d.text")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("run", F.count_if(F.col("op") == 0).over(w))


def patterns(pieces: DataFrame, key: str) -> DataFrame:
    """key, run, pattern of each run that is not equal: "-deleted+inserted"."""
    def side(op):
        return F.coalesce(F.max(F.when(F.col("op") == op, F.col("text"))), F.lit(""))

    return pieces.filter("op != 0").groupBy(key, "run").agg(F.concat(F.lit("-"), side(-1), F.lit("+"), side(1)).alias("pattern"))


def frequency_filter(pairs: DataFrame, words: DataFrame | Callable[[list[str] | None], DataFrame], key: str, threshold: int, diffs: str = "diffs") -> DataFrame:
    """key, diffs: runs whose pattern occurs more than `threshold` times and is no known word (words: word, in any number) are taken as no difference.

    words may be a function of the words that are asked for (None: more than FEW), so that only texts with them need be cut into words.

    What they delete becomes equal text and what they insert goes; a pair without differences keeps its equal text.
    """
    # the differences come from Python and are read four times
    pairs = checkpoint(pairs.select(key, diffs))
    pieces = runs(pairs, key, diffs)
    found = patterns(pieces, key)
    common = found.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") > threshold).select("pattern")
    common = checkpoint(common)
    # the words that could excuse a common pattern; only these are looked for among all words
    one_sided = common.select("pattern", F.coalesce(F.nullif(F.regexp_extract("pattern", r"(?s)^-(.+)\+$", 1), F.lit("")), F.regexp_extract("pattern", r"(?s)^-\+(.+)$", 1)).alias("word")).filter("word != ''")
    wanted = one_sided.select("word").distinct()
    n = wanted.count()
    known = words if isinstance(words, DataFrame) else words(sorted(r["word"] for r in wanted.collect()) if n <= FEW else None)
    met = known.select("word").join(F.broadcast(wanted) if n <= 100_000 else wanted, "word", "left_semi").distinct()
    common = common.join(one_sided.join(met, "word").select("pattern"), "pattern", "left_anti")
    usual = found.join(common, "pattern", "left_semi").select(key, "run", F.lit(True).alias("usual"))
    kept = pieces.join(usual, [key, "run"], "left").filter("not (op = 1 and usual is not null)")
    op = F.when((F.col("op") == -1) & F.col("usual").isNotNull(), 0).otherwise(F.col("op"))
    again = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", op.alias("op"), "text"))).alias("p"))
    merged = F.aggregate(
        "p", F.expr(f"cast(array() as {DIFF_TYPE})"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["op"] == p["op"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(p["op"].alias("op"), F.concat(F.element_at(acc, -1)["text"], p["text"]).alias("text")))),
        ).otherwise(F.concat(acc, F.array(F.struct(p["op"].alias("op"), p["text"].alias("text"))))),
    )
    empty = F.expr(f"cast(array() as {DIFF_TYPE})")
    return pairs.select(key).join(again.select(key, merged.alias("d")), key, "left").select(key, F.coalesce("d", empty).alias("diffs"))
