"""Differences, the frequency filter, suffixes, changes and reports against plain Python."""

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter
from html import escape

import pyarrow as pa
import pytest

from strophe import registry
from strophe.functions import diff
from strophe.functions.diff import edit_script
from strophe.operators import align, joins, ordered
from strophe.queries import compare
from strophe.queries.views import scripts

DIR = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


@pytest.fixture(scope="module")
def pairs(spark):
    return {r["pair_id"]: r for r in compare.pairs(spark, DIR).collect()}


def of(row):
    return [(x["op"], x["text"]) for x in row["diffs"]]


def test_char_diff(spark, pairs):
    """Both texts come back from each script, which keeps as much as any can."""
    for r in pairs.values():
        d = of(r)
        assert "".join(t for o, t in d if o <= 0) == r["base_text"] and "".join(t for o, t in d if o >= 0) == r["comp_text"]
    short = [r for r in pairs.values() if len(r["base_text"]) * len(r["comp_text"]) < 60_000]
    assert short and all(sum(len(t) for o, t in of(r) if o == 0) == lcs(r["base_text"], r["comp_text"]) for r in short)
    for r in registry.QUERIES["char_diff"](spark, DIR).collect():
        d = of(pairs[r["pair_id"]])
        assert (r["n_inserted"], r["n_deleted"]) == tuple(sum(len(t) for o, t in d if o == op) for op in (1, -1))
        assert r["is_match"] == all(o == 0 or not t.strip() for o, t in d) and r["longest"] == max([len(t) for o, t in d if o], default=0)


def test_compare_report(spark, pairs):
    def html(d):
        return "".join({0: "{}", -1: "<del>{}</del>", 1: "<ins>{}</ins>"}[o].format(escape(t, quote=False)) for o, t in d)

    got = {r["pair_id"]: r["html"] for r in registry.QUERIES["compare_report"](spark, DIR).collect()}
    assert got == {i: html(of(r)) for i, r in pairs.items() if max([len(t) for o, t in of(r) if o], default=0) > 2}


def test_gordon(spark, pairs):
    words = {t.lower() for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").collect() if r["text"] for t in re.findall(r"[^\W_]+(?:[^\s\w{][^\W_]+)*", r["text"])}
    runs = {}
    for i, r in pairs.items():
        run = 0
        for op, t in of(r):
            run += op == 0
            if op:
                runs.setdefault((i, run), {-1: "", 1: ""})[op] = t
    pattern = {k: f"-{v[-1]}+{v[1]}" for k, v in runs.items()}
    often = {p for p, n in Counter(pattern.values()).items() if n > 20}
    usual = {p for p in often if not any(p in (f"-{w}+", f"-+{w}") for w in (p[1:-1], p[2:]) if w in words)}
    want = {}
    for i, r in pairs.items():
        run, n = 0, {-1: 0, 1: 0}
        for op, t in of(r):
            run += op == 0
            if op and pattern[i, run] not in usual:
                n[op] += len(t)
        want[i] = (n[1], n[-1])
    got = {r["pair_id"]: (r["n_inserted"], r["n_deleted"]) for r in registry.QUERIES["gordon"](spark, DIR).collect()}
    assert often and got == want


def test_first_free_suffix(spark):
    rows = [(1, i, v) for i, v in enumerate(["6", "6", "6a", "6", "7", "6b"])] + [(2, i, "5") for i in range(27)] + [(3, i, v) for i, v in enumerate(["6a", "6", "6"])]
    df = spark.createDataFrame(rows, "chapter long, i long, verse string")
    got = {}
    for r in ordered.duplicate_suffix(df, ["chapter"], ["i"], "verse").orderBy("chapter", "i").collect():
        got.setdefault(r["chapter"], []).append(r["unique_name"])
    assert got[1] == ["6", "6a", "6aa", "6b", "7", "6ba"] and got[3] == ["6a", "6", "6b"]
    assert got[2] == ["5", *[f"5{c}" for c in "abcdefghijklmnopqrstuvwxyz"]]
    more = df.unionByName(spark.createDataFrame([(2, 30, "5")], df.schema))
    with pytest.raises(Exception, match="too many copies"):
        ordered.duplicate_suffix(more, ["chapter"], ["i"], "verse").collect()


def test_repeated_keys_in_changes(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    changes = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "z", 1)], "k long, v string, at long")
    for name in ("upsert", "keyed_update"):
        with pytest.raises(ValueError, match="repeat"):
            joins.upsert(target, changes.drop("at"), ["k"]) if name == "upsert" else joins.keyed_update(target, changes, ["k"], ["v"])
    assert sorted(map(tuple, joins.upsert(target.selectExpr("k", "v", "0L as at"), changes, ["k"], order="at").collect())) == [(1, "y", 2), (2, "b", 0), (3, "c", 0), (9, "z", 1)]
    assert sorted(map(tuple, joins.keyed_update(target, changes, ["k"], ["v"], order="at").collect())) == [(1, "y"), (2, "b"), (3, "c")]
    with pytest.raises(ValueError, match="exactly one"):
        joins.keyed_update(target, changes, ["k"], ["v"], expect_all=True, order="at")
    # one key met twice and one not at all
    twice = target.unionByName(target.filter("k = 1"))
    with pytest.raises(ValueError, match="exactly one"):
        joins.keyed_update(twice, spark.createDataFrame([(1, "x"), (9, "z")], "k long, v string"), ["k"], ["v"], expect_all=True)


def script_steps(a, b):
    """(op, char, place in a) of every step of the edit script."""
    at = 0
    for op, text in edit_script(a, b):
        for c in text:
            yield op, c, at
            at += op <= 0


def test_asr_align(spark):
    """Every heard character falls to the line that holds the place it stands at, looked up by scanning the lines."""
    lines = {}
    for r in scripts(spark, DIR).select("chapter_num", "script_id", "script_text").collect():
        lines.setdefault(r["chapter_num"], []).append((r["script_id"], r["script_text"] or ""))
    got = {r["script_id"]: r["asr_text"] for r in registry.QUERIES["asr_align"](spark, DIR).collect()}
    want = {}
    for own in lines.values():
        own.sort()
        heard = " ".join(re.sub(r"^\S+\s?", "", t) for _, t in own)
        owner = [i for i, t in own for _ in t + " "]
        found = {i: "" for i, _ in own}
        for op, c, at in script_steps("".join(t + " " for _, t in own), heard):
            if op >= 0:
                found[owner[min(at, len(owner) - 1)]] += c
        want |= {i: t.strip() for i, t in found.items()}
    assert got == want and len(got) > 50


def test_asr_splice(spark):
    texts = {r["script_id"]: r["script_text"] for r in scripts(spark, DIR).select("script_id", "script_text").collect()}
    got = {}
    for r in registry.QUERIES["asr_splice"](spark, DIR).collect():
        got.setdefault(r["script_id"], []).append(tuple(r)[1:])
    for i, text in texts.items():
        heard = re.sub("[aeiou]", lambda m: m[0] * 2, text)
        want = []
        for op, c, at in script_steps(text, heard):
            if op <= 0:
                want.append((c, at * 0.1, at * 0.1 + 0.08, 0.5, False))
            elif at and (at - 1) % 3 == 0:
                end = (at - 1) * 0.1 + 0.08
                want.append((c, end, end + 0.02, 1.0, True))
        own = sorted(got.get(i, []))
        assert [r[1] for r in own] == [w[0] for w in want] and [r[5] for r in own] == [w[4] for w in want]
        assert [x for r in own for x in r[2:5]] == pytest.approx([x for w in want for x in w[1:4]])


def ctc_score(frames, labels, expected, bonus=1.0):
    """The log of the summed probability of all paths that collapse to the labels, with the bonus of each expected one: the forward algorithm."""
    states = [0, *[x for k in labels for x in (k, 0)]]
    score = [-math.inf] * len(states)
    gain = [bonus if i < len(expected) and expected[i] == k else 0.0 for i, k in enumerate(labels)]

    def plus(*x):
        top = max(x)
        return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in x))

    for t, f in enumerate(frames):
        new = []
        for s, k in enumerate(states):
            came = [score[s]] if t else [0.0 if s == 0 else -math.inf]
            up = gain[s // 2] if s % 2 else 0.0
            if s >= 1:
                came.append((score[s - 1] if t else (0.0 if s == 1 else -math.inf)) + up)
            if t and s >= 2 and s % 2 and k != states[s - 2]:
                came.append(score[s - 2] + up)
            new.append(plus(*came) + f[k])
        score = new
    return plus(score[-1], score[-2]) if len(states) > 1 else score[-1]


def test_guided_beam_over_all_labels():
    """A beam wide enough finds the best of all label sequences, each scored by the forward algorithm."""
    rng = random.Random(6)
    for _ in range(60):
        frames = [[math.log(rng.random()) for _ in range(3)] for _ in range(rng.randrange(1, 5))]
        expected = [rng.randrange(1, 3) for _ in range(2)]
        all_labels = [list(x) for n in range(len(frames) + 1) for x in itertools.product((1, 2), repeat=n)]
        best = max(ctc_score(frames, x, expected) for x in all_labels)
        got = align.guided_beam(frames, expected, width=10_000)
        assert ctc_score(frames, got, expected) == pytest.approx(best)


def test_beam_over_the_table(spark):
    """No label sequence that differs from a row's path by one change scores higher by more than what a beam of 8 may lose, which is seldom anything."""
    given = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    got = registry.QUERIES["beam"](spark, DIR).collect()
    assert {r["vec_id"] for r in got} == set(given)
    lost = 0
    for r in got[:150]:
        x = [[float(v) for v in given[r["vec_id"]][8 * t : 8 * t + 8]] for t in range(8)]
        frames = [[v - max(f) - 1 for v in f] for f in x]
        own = ctc_score(frames, r["path"], [1, 2, 3])
        near = [r["path"][:i] + r["path"][i + 1 :] for i in range(len(r["path"]))] + [[*r["path"], k] for k in range(1, 8)]
        lost += max(ctc_score(frames, n, [1, 2, 3]) for n in near) > own + 1e-9
    assert lost <= 15


def test_scripts_are_packed_in_slices(monkeypatch):
    """Pieces become Arrow's memory as they come, and a long pair's table is made in blocks with the same script."""
    rng = random.Random(3)
    texts = [("".join(rng.choices("abcde ", k=n)), "".join(rng.choices("abcde ", k=n))) for n in [0, 1, 1, 40, 300] + [400] * 300]
    a, b = pa.array([None, *(x for x, _ in texts)]), pa.array(["x", *(y for _, y in texts)])
    want = [[{"op": o, "text": t} for o, t in edit_script(x or "", y)] for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    monkeypatch.setattr(diff, "PIECES", 1 << 10)
    monkeypatch.setattr(diff, "MOST_BITS", 1 << 10)
    tracemalloc.start()
    got = diff.packed(a, b, edit_script)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == want and sum(map(len, want)) > 50_000
    assert peak < 2_000_000


def test_a_filter_makes_no_second_script(spark):
    for name in ("char_diff", "compare_report"):
        plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("EvalPython") == 1


def test_splice_keeps_text_out_of_the_characters(spark):
    """Lines are dealt out as texts, with no copy of the heard text beside each character, and a line's characters end before rows are made."""
    plan = registry.QUERIES["asr_splice"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == plan.count("Exchange") == 1 and "chars" not in plan[plan.index("Exchange") :] and re.search(r"Generate inline\(rows#\d+\), \[script_id#\d+L\]", plan)
    rows = [(1, i, c, i * 1.0, i + 0.5, 0.5, 0.25, c == "b", "xabyyc" if i == 0 else None) for i, c in enumerate("abc")] + [(2, 5, "é", 0.0, 1.0, 0.5, 0.25, None, None), (3, 0, "a", 0.0, 1.0, 0.5, 0.25, True, "a𝄞𝄞")]
    df = spark.createDataFrame(rows, "line long, seq int, ch string, begin_ts double, end_ts double, score double, gap double, flag boolean, asr_text string")
    got = [tuple(r) for r in align.splice_asr(df, "line").orderBy("line", "seq").collect()]
    assert got == [
        (1, 0, "a", 0.0, 0.5, 0.5, False), (1, 1, "b", 1.0, 1.5, 0.5, False), (1, 2, "y", 1.5, 1.75, 1.0, True), (1, 3, "y", 1.5, 1.75, 1.0, True), (1, 4, "c", 2.0, 2.5, 0.5, False),
        (2, 0, "é", 0.0, 1.0, 0.5, False), (3, 0, "a", 0.0, 1.0, 0.5, False), (3, 1, "𝄞", 1.0, 1.25, 1.0, True), (3, 2, "𝄞", 1.0, 1.25, 1.0, True),
    ]
