"""Quality rules with suffix-array repetition.

For the words of each text a suffix array is built by prefix doubling over whole Arrow batches at once (the document
is part of the first key, so suffixes of two documents never share a prefix). Longest common prefixes come from the
kept doubling levels. L(i), the longest repeat that starts at word i, is the larger of its two neighbouring prefixes:
the spans [i, i + L(i)) with L(i) >= `min_repeat` are the occurrences of the maximal repeated substrings of the LCP
intervals; their union gives the covered fraction, their maximum the longest repeat.

Defined results: null text is a text without words (base_failed, not kept); null ids and repeated rows stay, one row
each; an empty table gives an empty result; extra columns are ignored. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm.common import IS_SPACE, slices, sums, text_buffers, text_rows

#: Bytes of text that are looked at together: the doubling levels of a slice take some hundred bytes a word.
SLICE = 1 << 20

IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True


def lcp_of_neighbours(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the longest prefix (in symbols, inside its document) that its suffix shares with any other suffix of the document."""
    n = len(key)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    first = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    last_of_doc = np.searchsorted(doc, doc, side="right")
    levels, h = [rank], 1
    while True:
        # members of groups of two or more, as runs of the order
        size = np.diff(np.concatenate((np.flatnonzero(first), [n])))
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        pos = order[at]
        nxt = pos + h
        second = np.where(nxt < last_of_doc[pos], rank[np.minimum(nxt, n - 1)] + 1, 0)
        head = rank[pos]
        by = np.argsort(head * (n + 1) + second, kind="stable")
        pos, second, head = pos[by], second[by], head[by]
        order[at] = pos
        new = np.concatenate(([True], (head[1:] != head[:-1]) | (second[1:] != second[:-1])))
        first = first.copy()
        first[at] = new
        rank = rank.copy()
        rank[pos] = np.maximum.accumulate(np.where(new, at, 0))
        levels.append(rank)
        h *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(n - 1, 0), np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b]) if n > 1 else np.zeros(0, np.int64)
    a, b = a[live], b[live]
    got = np.zeros(len(live), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        inside &= (a < last_of_doc[np.minimum(order[live], n - 1)]) & (b < last_of_doc[np.minimum(order[live], n - 1)])
        r = levels[level]
        same = inside.copy()
        same[inside] = r[a[inside]] == r[b[inside]]
        got += same * (1 << level)
        a, b = a + same * (1 << level), b + same * (1 << level)
    shared[live] = got
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = shared
    longest[order[1:]] = np.maximum(longest[order[1:]], shared)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def measure(batch: pa.RecordBatch, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of each row of (doc_id, text)."""
    text = batch.column("text")
    rows = batch.num_rows
    offsets, raw = text_buffers(text)
    space = IS_SPACE[raw]
    out = {
        "word_chars": sums(((raw & 0xC0) != 0x80) & ~space, offsets),
        "n_symbols": sums(IS_SYMBOL[raw], offsets),
    }
    lists = pc.ascii_split_whitespace(text)
    words = pc.list_flatten(lists)
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(words, "")
    words, doc = words.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    key = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(key)
    bounds = np.searchsorted(doc, np.arange(rows + 1))
    out["n_words"] = np.diff(bounds)

    longest = lcp_of_neighbours(key, doc)
    at = np.flatnonzero(longest >= 3)
    out["n_repeat_words"] = sums(covered(at, np.full(len(at), 3), n), bounds)
    at = np.flatnonzero(longest >= min_repeat)
    out["n_covered_words"] = sums(covered(at, longest[at], n), bounds)
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, doc[at], longest[at])
    out["longest_repeat"] = top

    lists = pc.split_pattern(text, "\n")
    lines = pc.list_flatten(lists)
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lines.dictionary_encode()
    filled = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = filled[code] if len(code) else np.zeros(0, bool)
    code, doc = code[keep], doc[keep]
    distinct = np.unique(doc * (len(filled) + 1) + code) // (len(filled) + 1)
    out["n_dup_lines"] = np.bincount(doc, minlength=rows) - np.bincount(distinct, minlength=rows)
    return out


def verdict(of: Callable[[str], Column], min_words: int = 50, max_repeat_percent: int = 50, max_covered_percent: int = 40, max_longest: int = 100) -> tuple[Column, Column]:
    """base_failed and kept from the counts."""
    failed = (of("n_words") < min_words) | (100 * of("n_repeat_words") > max_repeat_percent * of("n_words"))
    limits = (100 * of("n_covered_words") <= max_covered_percent * of("n_words")) & (of("longest_repeat") <= max_longest)
    return failed, ~failed & limits


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]


def repetition(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50,
    min_repeat: int = 10, max_covered_percent: int = 40, max_longest: int = 100,
) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row.

    A document is kept unless the base rules reject it, or repeats of `min_repeat` or more words cover more than
    `max_covered_percent` of its words, or its longest repeat has more than `max_longest` words.
    """

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            got = measure(batch, min_repeat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[c].astype(np.int64)) for c in COLUMNS)], names=["doc_id", *COLUMNS])

    counts = text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS))
    failed, kept = verdict(F.col, min_words, max_repeat_percent, max_covered_percent, max_longest)
    return counts.withColumn("base_failed", failed).withColumn("kept", kept)


def filter_kept(docs: DataFrame, text_col: str = "text", min_repeat: int = 10, **limits: int) -> DataFrame:
    """The rows of docs that repetition() keeps, with all their columns: the text is measured where it lies, without a join."""
    names, mark = docs.columns, "_"
    while any(c.startswith(mark) for c in names):
        mark += "_"
    added = {c: f"{mark}{c}" for c in COLUMNS}

    def run(batches):
        for whole in batches:
            filled = pc.fill_null(whole.column(text_col), "")
            parts = list(slices(iter([pa.RecordBatch.from_arrays([pa.array(range(whole.num_rows)), filled], names=["doc_id", "text"])]), limit=SLICE))
            got = [measure(p, min_repeat) for p in parts]
            counts = [pa.array(np.concatenate([g[c] for g in got]).astype(np.int64) if got else [], pa.int64()) for c in COLUMNS]
            yield pa.RecordBatch.from_arrays([*whole.columns, *counts], names=[*names, *(added[c] for c in COLUMNS)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(added[c], T.LongType()) for c in COLUMNS)])
    return docs.mapInArrow(run, schema).filter(verdict(lambda c: F.col(added[c]), **limits)[1]).select(*[F.col(f"`{c}`") for c in names])
