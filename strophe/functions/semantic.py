"""Edit scripts that people can read: short equalities go, edits move to the edges of words, overlaps are cut out.

A script is taken as equal texts with edits (deleted, inserted) between them. In this order:

1. An equal text between two edits that is no longer than the longer side of the edit before it, and of the one after
   it, becomes part of one edit with both; the first such text first, until there is none.
2. An edit that only deletes or only inserts and has equal text on both sides slides to where its two edges score most:
   at the end of the text, after a blank line, at a line's end, after a sentence, at white space, at any other character
   that is no letter or digit, in this order; of equals the furthest to the right.
3. Where the deleted text ends as the inserted one begins (or the other way round) for half of either or more, what
   they share is equal text again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from strophe.functions.diff import DIFFS, edit_script, packed

Script = list[tuple[int, str]]


def parts(script: Script) -> tuple[list[str], list[tuple[str, str]]]:
    """Equal texts (one more than edits, the outer ones perhaps empty) and the edits between them."""
    equal, edits, before = [""], [], 0
    for op, text in script:
        if op == 0:
            equal[-1] += text
        elif before == 0:
            edits.append(("", ""))
            equal.append("")
        if op:
            deleted, inserted = edits[-1]
            edits[-1] = (deleted + text, inserted) if op < 0 else (deleted, inserted + text)
        before = op
    return equal, edits


def script_of(equal: list[str], edits: list[tuple[str, str]]) -> Script:
    out: Script = []
    for i, text in enumerate(equal):
        if i:
            out += [(op, t) for op, t in zip((-1, 1), edits[i - 1], strict=True) if t]
        if text and out and out[-1][0] == 0:
            out[-1] = (0, out[-1][1] + text)
        elif text:
            out.append((0, text))
    return out


def joined(script: Script) -> Script:
    """Short equalities become part of the edits around them."""
    equal, edits = parts(script)
    i = 1
    while i < len(equal) - 1:
        (d, n), (e, m) = edits[i - 1], edits[i]
        if len(equal[i]) <= min(max(len(d), len(n)), max(len(e), len(m))):
            edits[i - 1 : i + 1] = [(d + equal[i] + e, n + equal[i] + m)]
            del equal[i]
            i = max(1, i - 1)
        else:
            i += 1
    return script_of(equal, edits)


def edge(before: str, after: str) -> int:
    """How good a place between two texts is to cut."""
    if not before or not after:
        return 6
    a, b = before[-1], after[0]
    if before.endswith(("\n\n", "\n\r\n")) or after.startswith(("\n\n", "\n\r\n", "\r\n\r\n")):
        return 5
    if a in "\r\n" or b in "\r\n":
        return 4
    if not a.isalnum() and not a.isspace() and b.isspace():
        return 3
    if a.isspace() or b.isspace():
        return 2
    return 1 if not a.isalnum() or not b.isalnum() else 0


def aligned(script: Script) -> Script:
    """One-sided edits slide to the best edges."""
    equal, edits = parts(script)
    for i, (deleted, inserted) in enumerate(edits):
        text = deleted or inserted
        if (deleted and inserted) or not equal[i] or not equal[i + 1]:
            continue
        left, right = equal[i], equal[i + 1]
        while left and left[-1] == text[-1]:
            left, text, right = left[:-1], left[-1] + text[:-1], text[-1] + right
        best, found = -1, (left, text, right)
        while True:
            score = edge(left, text) + edge(text, right)
            if score >= best:
                best, found = score, (left, text, right)
            if not right or text[0] != right[0]:
                break
            left, text, right = left + text[0], text[1:] + right[0], right[1:]
        equal[i], text, equal[i + 1] = found
        edits[i] = (text, "") if deleted else ("", text)
    keep = [i for i in range(1, len(equal) - 1) if not equal[i]]
    for i in reversed(keep):  # edits that have come to touch
        edits[i - 1 : i + 1] = [(edits[i - 1][0] + edits[i][0], edits[i - 1][1] + edits[i][1])]
        del equal[i]
    return script_of(equal, edits)


def overlap(a: str, b: str) -> int:
    """The longest end of a that b begins with."""
    return next((n for n in range(min(len(a), len(b)), 0, -1) if a.endswith(b[:n])), 0)


def split(script: Script) -> Script:
    """Overlaps of a deleted and an inserted text are equal text."""
    equal, edits = parts(script)
    out: Script = []
    for i, text in enumerate(equal):
        if i:
            d, n = edits[i - 1]
            one, two = overlap(d, n), overlap(n, d)
            k = max(one, two)
            if k and (2 * k >= len(d) or 2 * k >= len(n)):
                out += [(-1, d[:-k]), (0, n[:k]), (1, n[k:])] if one >= two else [(1, n[:-k]), (0, d[:k]), (-1, d[k:])]
            else:
                out += [(-1, d), (1, n)]
        out.append((0, text))
    merged: Script = []
    for op, text in out:
        if text and merged and merged[-1][0] == op:
            merged[-1] = (op, merged[-1][1] + text)
        elif text:
            merged.append((op, text))
    return merged


def readable(script: Script) -> Script:
    return split(joined(aligned(joined(script))))


@F.arrow_udf(DIFFS)
def semantic_diff(a: pa.Array, b: pa.Array) -> pa.Array:
    """The readable edit script of two texts without the white space around them; null counts as empty."""
    return packed(a, b, lambda x, y: readable(edit_script(x.strip(), y.strip())))
