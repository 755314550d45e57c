"""Readable edit scripts against each rule applied by brute force, and over the whole small table."""

import random
from html import escape

import pytest

from strophe.functions import semantic
from strophe.functions.diff import edit_script
from strophe.queries import compare

DIR = "/root/testdata/sf0.001"


def texts_of(script):
    return "".join(t for o, t in script if o <= 0), "".join(t for o, t in script if o >= 0)


def cases(n=400):
    rng = random.Random(3)
    for _ in range(n):
        a = "".join(rng.choice("ab c.\n") for _ in range(rng.randrange(30)))
        b = list(a)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = rng.choice(["", "a", "bc", " c"])
        yield a, "".join(b)


def islands(script):
    """(position in both texts, deleted, inserted) of every edit, from the script read piece by piece."""
    out, i, j, last = [], 0, 0, 0
    for op, t in script:
        if op and (not out or last == 0):
            out.append([i, j, "", ""])
        if op < 0:
            out[-1][2] += t
        elif op > 0:
            out[-1][3] += t
        i, j, last = i + len(t) * (op <= 0), j + len(t) * (op >= 0), op
    return out


def brute_joined(script):
    """Rule 1 on positions: join the first two neighbouring edits that are near enough, from the begin again each time."""
    a, b = texts_of(script)
    own = [(i, i + len(d), j, j + len(n)) for i, j, d, n in islands(script)]
    while True:
        for k in range(len(own) - 1):
            (i, ie, j, je), (x, xe, y, ye) = own[k], own[k + 1]
            if x - ie <= max(ie - i, je - j) and x - ie <= max(xe - x, ye - y):
                own[k : k + 2] = [(i, xe, j, ye)]
                break
        else:
            return [(a[i:ie], b[j:je]) for i, ie, j, je in own]


def test_short_equalities():
    for a, b in cases():
        got = semantic.joined(edit_script(a, b))
        assert texts_of(got) == (a, b)
        assert [(d, n) for _, _, d, n in islands(got)] == brute_joined(edit_script(a, b))


def test_slides_to_the_best_edges():
    for a, b in cases():
        script = edit_script(a, b)
        if len(islands(script)) != 1:
            continue
        i, _, d, n = islands(script)[0]
        got = semantic.aligned(script)
        assert texts_of(got) == (a, b)
        if bool(d) == bool(n) or i == 0 or i + len(d) == len(a):
            continue
        whole, size = (a, len(d)) if d else (b, len(n))
        rest = b if d else a
        places = [p for p in range(len(whole) - size + 1) if whole[:p] + whole[p + size :] == rest]
        best = max(places, key=lambda p: (semantic.edge(whole[:p], whole[p : p + size]) + semantic.edge(whole[p : p + size], whole[p + size :]), p))
        assert islands(got)[0][0] == best


def test_overlaps():
    for d, n in cases():
        if not d or not n:
            continue
        got = semantic.split([(0, "x"), (-1, d), (1, n), (0, "y")])
        assert texts_of(got) == ("x" + d + "y", "x" + n + "y")
        shared = max(k for k in range(min(len(d), len(n)) + 1) if d[len(d) - k :] == n[:k] or n[len(n) - k :] == d[:k])
        kept = sum(len(t) for o, t in got if o == 0) - 2
        assert kept == (shared if shared and 2 * shared >= min(len(d), len(n)) else 0)


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("The cat came", "The cat and dog came", [(0, "The cat "), (1, "and dog "), (0, "came")]),
        ("mouse", "sofas", [(-1, "mouse"), (1, "sofas")]),
        ("", "", []),
        ("same", "same", [(0, "same")]),
        ("", "x", [(1, "x")]),
        ("The xaxcx and", "The xaxcx zzz and", [(0, "The xaxcx "), (1, "zzz "), (0, "and")]),
    ],
)
def test_examples(a, b, want):
    assert semantic.readable(edit_script(a, b)) == want


def test_whole_table(spark):
    given = {r["pair_id"]: (r["base_text"].strip(), r["comp_text"].strip()) for r in compare.pairs(spark, DIR).collect()}
    tags = {0: "{}", -1: "<del>{}</del>", 1: "<ins>{}</ins>"}
    got = compare.semantic_diff(spark, DIR).collect()
    assert {r["pair_id"] for r in got} == set(given)
    for r in got:
        a, b = given[r["pair_id"]]
        first = semantic.joined(edit_script(a, b))
        assert [(d, n) for _, _, d, n in islands(first)] == brute_joined(edit_script(a, b))
        script = semantic.readable(edit_script(a, b))
        assert texts_of(script) == (a, b) and r["n_pieces"] == len(script)
        assert r["html"] == "".join(tags[o].format(escape(t, quote=False)) for o, t in script)
        assert r["n_deleted"] - r["n_inserted"] == len(a) - len(b)
