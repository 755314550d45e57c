"""Forced alignment against all paths, windows against the whole recording, the lexicon decoder against all words."""

import itertools

import numpy as np
import pytest

from strophe.operators import ctc, lexicon
from strophe.queries import speech

DIR = "/root/testdata/sf0.001"


def collapse(path, blank=0):
    return [k for k, _ in itertools.groupby(path) if k != blank]


def best_of_all(frames, labels):
    """(score, path) over every path that collapses to the labels."""
    n = len(frames[0])
    paths = [p for p in itertools.product(range(n), repeat=len(frames)) if collapse(p) == labels]
    return max(((sum(frames[t][k] for t, k in enumerate(p)), p) for p in paths), default=None)


def test_small_cases_over_all_paths():
    rng = np.random.default_rng(1)
    for time, labels in itertools.product(range(1, 6), ([], [1], [2, 1], [1, 1], [1, 2, 1], [2, 2, 2], [1, 2, 2, 1])):
        frames = np.log(rng.dirichlet(np.ones(3), time))
        total, states = ctc.best_paths(frames[None], np.array([labels], np.int64).reshape(1, -1), 0)
        want = best_of_all(frames.tolist(), labels)
        if want is None:
            assert total[0] == -np.inf
        else:
            path = [labels[s // 2] if s % 2 else 0 for s in states[0].tolist()]
            assert total[0] == pytest.approx(want[0]) and tuple(path) == want[1]


def test_long_recordings_go_back_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    frames, labels = np.log(rng.dirichlet(np.ones(6), (2, 700))), rng.integers(1, 6, (2, 200))
    whole = ctc.best_paths(frames, labels, 0)
    for block in (1, 7, 699, 700, 10_000):
        monkeypatch.setattr(ctc, "BLOCK", block)
        got = ctc.best_paths(frames, labels, 0)
        assert (got[0] == whole[0]).all() and (got[1] == whole[1]).all()


def test_whole_table(spark):
    """Score, path and spans of every vector; the paths through the eight frames by going through all ways to cut them."""
    given = {r["vec_id"]: r for r in speech.frames(spark, DIR).collect()}
    got = speech.forced_alignment(spark, DIR).collect()
    assert {r["vec_id"] for r in got} == set(given)
    for r in got:
        x, k, label = np.array(given[r["vec_id"]]["frames"]), r["vec_id"], given[r["vec_id"]]["label"]
        labels = [k % 7 + 1, label % 7 + 1, (k + label) % 7 + 1]
        total = np.concatenate((np.zeros((1, 8)), np.cumsum(x, axis=0)))
        best = -np.inf
        for a, b, c, d, e, f in itertools.combinations_with_replacement(range(9), 6):
            if a < b <= c < d <= e < f and (labels[0] != labels[1] or b < c) and (labels[1] != labels[2] or d < e):
                of = [(labels[0], a, b), (labels[1], c, d), (labels[2], e, f), (0, 0, a), (0, b, c), (0, d, e), (0, f, 8)]
                best = max(best, sum(total[hi, lab] - total[lo, lab] for lab, lo, hi in of))
        assert r["score"] == pytest.approx(best, abs=2e-6) and collapse(r["path"]) == labels
        assert sum(x[t, lab] for t, lab in enumerate(r["path"])) == pytest.approx(best, abs=2e-6)
        assert [s["label"] for s in r["spans"]] == labels
        for s in r["spans"]:
            assert r["path"][s["start"] : s["stop"]] == [s["label"]] * (s["stop"] - s["start"])
            assert s["score"] == pytest.approx(np.exp(x[s["start"] : s["stop"], s["label"]]).mean())


def test_rows_without_a_path(spark):
    p = [-1.0, -1.0, -1.0]
    rows = [(1, None, None), (2, [], []), (3, [], [1]), (4, [p], [1, 2]), (5, [p, p], [1, 1]), (6, [p], [0]), (7, [p], [3]), (8, [p, p[:2]], [1]), (9, [p], None), (10, [[None, 0.0, 0.0]], [1]), (None, [p], [2]), (12, [p], [None])]
    df = spark.createDataFrame(rows, "id int, f array<array<double>>, l array<int>")
    got = {r["id"]: (r["score"], r["path"], len(r["spans"])) for r in ctc.forced_align(df, "id", "f", "l").collect()}
    none = (None, None, 0)
    assert got == {1: (0.0, [], 0), 2: (0.0, [], 0), 3: none, 4: none, 5: none, 6: none, 7: none, 8: none, 9: (-1.0, [0], 0), 10: none, None: (-1.0, [2], 1), 12: none}
    assert ctc.forced_align(df.limit(0), "id", "f", "l").collect() == []


def test_windows_equal_the_whole(spark):
    """A recording of 130 windows; what looks further than the context differs only near the borders."""
    x = np.random.default_rng(5).normal(size=(1_300, 2))
    rows = [("a", i, v.tolist()) for i, v in enumerate(x)] + [(None, i, [float(i), 0.0]) for i in range(3)] + [("b", None, [1.0, 1.0]), ("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, t long, v array<double>").repartition(7)

    def of(context, radius):
        got = ctc.in_windows(df, "k", "t", "v", 10, context, lambda w: speech.smooth(w, radius)).collect()
        return {(r["k"], r["t"]): r["out"] for r in got}

    got = of(3, 3)
    assert set(got) == {("a", i) for i in range(1_300)} | {(None, i) for i in range(3)}
    assert np.allclose([got["a", i] for i in range(1_300)], speech.smooth(x, 3))
    assert np.allclose([got[None, i] for i in range(3)], [[1.0, 0.0]] * 3)
    far = of(25, 25)
    assert np.allclose([far["a", i] for i in range(1_300)], speech.smooth(x, 25))
    short = of(2, 3)
    near = np.array([short["a", i] for i in range(1_300)])
    off = np.flatnonzero(~np.isclose(near, speech.smooth(x, 3)).all(axis=1))
    assert set(off % 10) <= {0, 9}


def test_window_plan_of_one_recording(spark):
    df = spark.createDataFrame([("a", 65.0), ("b", 0.0), ("c", None)], "k string, s double")
    got = [tuple(r) for r in ctc.window_plan(df, "k", "s").orderBy("window").collect()]
    assert got == [("a", 0, 0, 1500, 0, 1650), ("a", 1, 1500, 3000, 1350, 3150), ("a", 2, 3000, 3250, 2850, 3250)]


def reading(frames, spellings, table, order, weight=1.0, bonus=0.0):
    """Best (score, words) over all sequences of words and all their paths (by best_paths, itself tested above)."""
    scores = {(tuple(h), w): s for h, w, s in table}

    def score(history, word):
        for cut in range(len(history) + 1):
            if (history[cut:], word) in scores:
                return cut * lexicon.BACK_OFF + scores[history[cut:], word]
        return len(history) * lexicon.BACK_OFF + lexicon.UNSEEN

    found = []
    for n in range(1, len(frames) + 1):
        for words in itertools.product(sorted(spellings), repeat=n):
            labels = [x for w in words for x in spellings[w]]
            if len(labels) > len(frames):
                continue
            total = ctc.best_paths(np.array([frames]), np.array([labels]), 0)[0][0]
            if total > -np.inf:
                history = ["<s>", *words]
                said = sum(score(tuple(history[: i + 1][-(order - 1) :]) if order > 1 else (), w) for i, w in enumerate([*words, "</s>"]))
                found.append((-(total + weight * said + bonus * n), list(words)))
    return min(found, default=None)


def test_lexicon_over_all_word_sequences(spark):
    rng = np.random.default_rng(7)
    spellings = {"a": [1], "b": [2], "ab": [1, 2], "aa": [1, 1], "ba": [2, 1], "too": [3, 3, 3, 3, 3, 3]}
    lines = spark.createDataFrame([(x.split(),) for x in ("a b", "ab a", "b a b", "aa", "a a b")] + [(None,), ([],), ([None, "b"],)], "words array<string>")
    rows = [(i, np.log(rng.dirichlet(np.ones(4), 1 + i % 5)).tolist()) for i in range(40)]
    df = spark.createDataFrame([*rows, (98, None), (99, []), (None, rows[3][1])], "id int, f array<array<double>>")
    known = spark.createDataFrame([*spellings.items(), ("x", []), ("y", [0, 1]), (None, [1]), ("a", [1])], "word string, labels array<int>")
    for order in (1, 2, 3):
        table = lexicon.ngrams(lines, "words", order)
        plain = [(r["history"], r["word"], r["score"]) for r in table.collect()]
        got = {r["id"]: r for r in lexicon.decode(df, "id", "f", known, table, order, 0.7, 0.3).collect()}
        assert len(got) == 43 and got[98]["words"] is got[99]["score"] is None
        for i, f in rows:
            want = reading(f, spellings, plain, order, 0.7, 0.3)
            assert got[i]["words"] == want[1] and got[i]["score"] == pytest.approx(-want[0])
        assert got[None]["words"] == got[3]["words"]


def test_lexicon_query_scores_are_reached(spark):
    """Over the whole small table no reading scores above the best path of its words; a narrower beam may lose that path, seldom."""
    words, lines = speech.short_words(spark, DIR)
    spelled = {r["word"]: list(r["labels"]) for r in words.collect()}
    own = lexicon.Decoder(list(spelled.items()), [(tuple(r["history"]), r["word"], r["score"]) for r in lexicon.ngrams(lines, "words").collect()], 3, 1.0, 0.0, 1, 0)
    given = {r["vec_id"]: r["frames"] for r in speech.frames(spark, DIR).collect()}
    got = speech.lexicon_decode(spark, DIR).collect()
    assert len(got) == len(given)
    short = []
    for r in got:
        if r["words"]:
            labels = [x for w in r["words"] for x in spelled[w]]
            history = ["<s>", *r["words"]]
            said = sum(own.score(tuple(history[: i + 1][-2:]), w) for i, w in enumerate([*r["words"], "</s>"]))
            short.append(ctc.best_paths(np.array([given[r["vec_id"]]]), np.array([labels]), 0)[0][0] + said - r["score"])
    assert len(short) > 400 and min(short) > -2e-6 and sum(x < 2e-6 for x in short) > 0.9 * len(short)


def test_too_large_a_lexicon_raises(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "MOST_WORDS", 1)
    known = spark.createDataFrame([("a", [1]), ("b", [2])], "word string, labels array<int>")
    lines = spark.createDataFrame([(["a"],)], "words array<string>")
    with pytest.raises(ValueError, match="more than 1 rows"):
        lexicon.decode(known.selectExpr("1 as id", "array(array(0.0D)) as f"), "id", "f", known, lexicon.ngrams(lines, "words"))


def test_lexicon_keeps_the_best_and_spreads_rows(spark):
    """Words left out of a full beam change nothing, for narrow and wide beams, and rows of one block go to many tasks."""
    rng = np.random.default_rng(5)
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("abcd", repeat=n)]
    spelled = [(w, [ord(c) % 3 + 1 for c in w]) for w in words]
    table = [((), w, float(x)) for w, x in zip(words, rng.uniform(-3, -1, len(words)), strict=True)] + [((a,), b, float(rng.uniform(-2, 0))) for a, b in rng.choice(words, (60, 2))] + [(("<s>",), w, -0.5) for w in words[::5]]

    for width in (3, 20, 5000):
        own = lexicon.Decoder(spelled, table, 3, 0.8, 0.1, width, 0)
        for n in (1, 4, 6):
            frames = np.log(rng.dirichlet(np.ones(4), n)).tolist()
            held, lexicon.KEPT = lexicon.KEPT, 5
            again = lexicon.Decoder(spelled, table, 3, 0.8, 0.1, width, 0).decode(frames)
            lexicon.KEPT = held
            assert own.decode(frames) == again
            if width == 5000:
                assert own.decode(frames) == lexicon.Decoder(spelled, table, 3, 0.8, 0.1, 10**9, 0).decode(frames)
    plan = speech.lexicon_decode(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
