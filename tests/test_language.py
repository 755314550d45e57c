"""The language tree: the sample searches, a chain of 100, cycles, and tool codes."""

import pytest

from strophe.operators import language

#: glottocode, parent.
SAMPLE = [
    ("indo1319", None), ("germ1287", "indo1319"), ("roma1334", "indo1319"), ("slav1255", "indo1319"), ("stan1293", "germ1287"), ("stan1295", "germ1287"), ("stan1290", "roma1334"),
    ("stan1288", "roma1334"), ("russ1263", "slav1255"), ("british", "stan1293"), ("american", "stan1293"), ("australian", "stan1293"),
]


def search_one(parents, supported, start, limit=1_000):
    """The climb of one start, step by step."""
    children = {}
    for i, p in parents.items():
        children.setdefault(p, []).append(i)
    final, up, down, node = [], -1, 0, start
    while limit > 0 and node is not None:
        up += 1
        level, down, results = [node], 0, []
        depth = 0
        while level and depth <= limit:
            down = depth
            results = [i for i in level if i in supported]
            if results:
                break
            level = [c for i in level for c in children.get(i, [])]
            depth += 1
        if results:
            final, limit = results, down - 1
        node = parents[node]
    return sorted(final), up + down


@pytest.mark.parametrize(
    ("supported", "found", "distance"),
    [
        (["stan1293"], ["stan1293"], 0), (["american"], ["american"], 1), (["germ1287"], ["germ1287"], 1), (["indo1319"], ["indo1319"], 2),
        (["british", "american", "australian"], ["american", "australian", "british"], 1), (["germ1287", "roma1334"], ["germ1287"], 1), ([], [], 4), (["russ1263"], ["russ1263"], 4),
    ],
)
def test_sample_searches(spark, supported, found, distance):
    nodes = spark.createDataFrame([(i, p, i in supported) for i, p in SAMPLE], "id string, parent_id string, ok boolean")
    got = {r["id"]: (r["found"], r["distance"]) for r in language.tree_search(nodes, "ok").collect()}
    parents = dict(SAMPLE)
    assert got["stan1293"][0] == found and (got["stan1293"][1] == distance or not found)
    assert got == {i: search_one(parents, set(supported), i) for i in parents}


def test_a_chain_of_100(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(101)], "id long, parent_id long")
    up = language.ancestors(nodes)
    assert up.count() == 101 * 102 // 2 and up.filter("id = 100").count() == 101
    near = {r["id"]: (r["found"], r["distance"]) for r in language.nearest_supported(nodes, "id in (0, 90)").collect()}
    assert near[100] == (90, 10) and near[80] == (90, 10) and near[30] == (0, 30)
    parents = {i: i - 1 if i else None for i in range(101)}
    got = {r["id"]: (r["found"], r["distance"]) for r in language.tree_search(nodes, "id in (0, 90)").collect()}
    assert got == {i: search_one(parents, {0, 90}, i) for i in parents}


def test_a_cycle_raises(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, parent_id long")
    with pytest.raises(ValueError, match="cycle"):
        language.ancestors(nodes)


def test_random_trees(spark):
    import random

    rng = random.Random(7)
    parents = {i: rng.randrange(max(0, i - 6), i) if i and rng.random() > 0.05 else None for i in range(150)}
    supported = set(rng.sample(range(150), 12))
    nodes = spark.createDataFrame([(i, p, i in supported) for i, p in parents.items()], "id long, parent_id long, ok boolean")
    for limit in (1_000, 3):
        got = {r["id"]: (r["found"], r["distance"]) for r in language.tree_search(nodes, "ok", limit).collect()}
        assert got == {i: search_one(parents, supported, i, limit) for i in parents}


def test_override_and_tool_codes(spark):
    searched = spark.createDataFrame([("a", ["x", "y"], 1), ("b", [], 2)], "id string, found array<string>, distance long")
    requests = spark.createDataFrame([("a", ""), ("b", None), ("a", "own")], "id string, override string")
    assert sorted((r["id"], r["override"], r["language"]) for r in language.choose(requests, searched).collect() if r["override"] is not None) == [("a", "", "x"), ("a", "own", "own")]
    langs = spark.createDataFrame([(1, "eng", "en"), (2, "deu", "de"), (3, "xxx", None)], "n long, iso3 string, iso1 string")
    tool = spark.createDataFrame([("eng",), ("en",), ("de",), ("de",)], "iso string")
    assert sorted((r["n"], r["asr"]) for r in language.tool_codes(langs, tool, "asr").collect()) == [(1, "eng"), (2, "de"), (3, "")]
