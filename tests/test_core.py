"""Core operators: every registered query agrees with its SQL; sources, store, request, stream and text functions against small cases."""

import glob
import json
import math
import os
import random
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe import registry
from strophe.functions import diff, text as tx
from strophe.operators import align, joins, language, ordered, training
from strophe.plans import pipeline
from strophe.plans.request import RequestError, decode
from strophe.sources import sinks, text, timing
from strophe.store import Dataset
from strophe.streaming import queue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(v):
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    theirs = con.sql(registry.ORACLES[name])
    assert sorted(theirs.columns) == cols
    mine = sorted((plain(tuple(r)) for r in df.select(*cols).collect()), key=repr)
    assert mine == sorted((plain(r) for r in theirs.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


# --- differences


def shortest(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], last if x == y else 1 + min(d[j], d[j - 1])
    return d[-1]


def test_edit_scripts_are_right_and_shortest():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        script = diff.edit_script(a, b)
        assert "".join(t for o, t in script if o <= 0) == a and "".join(t for o, t in script if o >= 0) == b
        assert sum(len(t) for o, t in script if o) == shortest(a, b)
        assert all(x[0] != y[0] for x, y in zip(script, script[1:], strict=False))


def test_frequency_filter(spark):
    rows = [(i, f"say colour {i} now", f"say color {i} now") for i in range(5)] + [(9, "a new thing", "a thing"), (10, "same", "same")]
    pairs = spark.createDataFrame(rows, "id long, a string, b string").select("id", diff.char_diff("a", "b").alias("diffs"))
    words = spark.createDataFrame([("thing",), ("new",)], "word string")
    got = {r["id"]: [(d["op"], d["text"]) for d in r["diffs"]] for r in diff.frequency_filter(pairs, words, "id", 3).collect()}
    assert all(got[i] == [(0, f"say colour {i} now")] for i in range(5))
    assert "".join(t for o, t in got[9] if o == -1).strip() == "new" and got[10] == [(0, "same")]
    strict = {r["id"]: [(d["op"], d["text"]) for d in r["diffs"]] for r in diff.frequency_filter(pairs, words, "id", 5).collect()}
    assert any(o for o, _ in strict[0])


def test_diff_columns(spark):
    row = spark.createDataFrame([("a b<", "a  b&")], "a string, b string").select(diff.char_diff("a", "b").alias("d")).select(diff.is_match(F.col("d")).alias("m"), diff.html(F.col("d")).alias("h"), *[c.alias(n) for n, c in diff.totals(F.col("d")).items()]).first()
    assert not row["m"] and "<del>&lt;</del><ins>&amp;</ins>" in row["h"] and (row["n_inserted"], row["n_deleted"], row["longest"]) == (2, 1, 1)


def test_normalizer(spark):
    df = spark.createDataFrame([("é",), (None,)], "t string")
    assert [r[0] for r in df.select(diff.normalizer("remove")("t")).collect()] == ["e", None]
    assert df.select(F.length(diff.normalizer("nfd")("t"))).first()[0] == 2


# --- alignment


def test_assigned_text():
    assert align.assign_text([(1, "in the beginning"), (2, "was the word")], "in the begining was a word") == [(1, "in the begining"), (2, "was a word")]


def test_splice_inserts_only_after_flagged_gaps():
    import pandas as pd

    chars = pd.DataFrame({"ch": list("abc"), "begin_ts": [0.0, 1, 2], "end_ts": [0.5, 1.5, 2.5], "score": [0.1] * 3, "gap": [0.5] * 3, "flag": [True, False, False]})
    assert align.splice(chars.to_dict("records"), "axbyc") == [("a", 0.0, 0.5, 0.1, False), ("x", 0.5, 1.0, 1.0, True), ("b", 1.0, 1.5, 0.1, False), ("c", 2.0, 2.5, 0.1, False)]


def test_guided_beam():
    low, high = math.log(0.05), math.log(0.9)
    frames = [[low, high, low], [low, high, low], [high, low, low], [low, low, high]]
    assert align.guided_beam(frames, [1, 2]) == [1, 2]


def test_number_words(spark):
    assert [align.number_words(n) for n in (0, 21, 100, 1_012)] == ["zero", "twenty-one", "one hundred", "one thousand twelve"]
    df = spark.createDataFrame([("40",), ("1,000",), ("",), ("a1",)], "t string")
    assert [r[0] for r in df.select(align.spell_numbers("t")).collect()] == ["forty", "zero", "zero", "a1"]


# --- ordered


def test_carry_passes_through_one_word_verses(spark):
    rows = [(1, 0, "v1", 1.0), (1, 1, "v1", 5.0), (1, 2, "v2", 2.0), (1, 3, "v3", 1.0), (1, 4, "v4", 0.5), (1, 5, "v4", 9.0)]
    df = spark.createDataFrame(rows, "f int, i int, v string, s double")
    got = [r["carried"] for r in ordered.carry_last(df, "f", ["i"], "v", "s").orderBy("i").collect()]
    want = [r[3] for r in rows]
    for i in range(1, len(rows)):
        if rows[i][2] != rows[i - 1][2]:
            want[i] = max(want[i], want[i - 1])
    assert got == want


def test_nearest_ties_go_to_the_earlier(spark):
    points = spark.createDataFrame([(1, 1, 1.0), (1, 2, 9.0), (2, 3, 0.0)], "k int, id int, t double")
    frames = spark.createDataFrame([(1, 0.0, "a"), (1, 2.0, "b")], "k int, ft double, name string")
    got = {r["id"]: r["name"] for r in ordered.nearest(points, frames, "k", "t", "ft", ["name"]).collect()}
    assert got == {1: "a", 2: "b", 3: None}
    assert {r["id"]: r["name"] for r in ordered.forward(points, frames, "k", "t", "ft", ["name"]).collect()} == {1: "b"}


def test_batches(spark):
    df = spark.createDataFrame([("g", i, float(s)) for i, s in enumerate([1, 2, 3, 50, 4, 100])], "g string, i long, s double")
    got = training.pack_batches(df, "g", "i", "s", 12.0, 3).orderBy("batch").collect()
    assert [r["keys"] for r in got] == [[0, 1, 2], [4], [3], [5]] and sum(r["n_samples"] for r in got) == 6


def test_nearest_language(spark):
    nodes = spark.createDataFrame([(1, None, False), (2, 1, False), (3, 1, True), (4, 2, False), (5, 4, True)], "id long, parent_id long, ok boolean")
    got = {r["id"]: (r["found"], r["distance"]) for r in language.nearest_supported(nodes, "ok").collect()}
    assert got == {1: (3, 1), 2: (5, 2), 3: (3, 0), 4: (5, 1), 5: (5, 0)}


def test_updates(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id int, t string")
    assert sorted(map(tuple, joins.upsert(a, b, ["id"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, joins.keyed_update(a, b, ["id"], ["t"]).collect())) == [(1, "x"), (2, "z")]
    with pytest.raises(ValueError):
        joins.keyed_update(a, b, ["id"], ["t"], expect_all=True)


# --- text functions


def test_tokens_keep_everything(spark):
    samples = ["{1} In the don't-stop, “beginning”.{2}_{3} x", "", "  ", "é́ 日本 {", "a{4}"]
    df = spark.createDataFrame([(s,) for s in samples], "t string").select("t", tx.tokens(F.col("t")).alias("w"))
    got = {r["t"]: r["w"] for r in df.collect()}
    assert all("".join(w) == t for t, w in got.items())
    assert got[samples[0]][:3] == ["{1}", " ", "In"] and "don't-stop" in got[samples[0]] and "{2}_{3}" in got[samples[0]]
    types = df.select(F.explode("w").alias("w")).select("w", tx.token_type(F.col("w")).alias("k")).distinct().collect()
    assert {r["k"] for r in types if r["w"] in ("{1}", "{4}")} == {"V"} and {r["k"] for r in types if r["w"] == "{"} == {"P"}


def test_small_functions(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    assert [value(tx.leading_int(F.lit(s))) for s in ("6a", "", "12")] == [6, 0, 12]
    assert [value(tx.zero_fill(F.lit(s))) for s in ("12r", "123456")] == ["00012r", "123456"]
    assert value(tx.safe_join(F.array(*map(F.lit, ["Hello", ",", "(", "you", ")", "!"])))) == "Hello, (you)!"
    assert value(tx.spelling(F.lit("a-b"))) == "a-b a | b |"
    assert value(tx.latin_ratio(F.lit(""))) is None and value(tx.latin_ratio(F.lit("ab日本"))) == 0.5
    assert value(tx.strip_verse_marks(F.lit("{1-2} a {3}b"))) == "a b"


# --- sources, sinks, store


USX = """<usx version="3.0"><book code="GEN" style="id">x</book><para style="ide">UTF-8</para><chapter number="1" style="c"/>
<para style="s1">Head {one}</para><para style="p"><verse number="1" style="v"/>In the <char style="wj">beginning</char> <note style="f">no</note>God<verse eid="x"/><verse number="2-3"/>made.</para></usx>"""


def test_usx(spark, tmp_path):
    want = [("GEN", 1, "0", "Head (one)"), ("GEN", 1, "1", "In the beginning God"), ("GEN", 1, "2-3", "made.")]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/001GEN.usx").write_text(USX)
    (tmp_path / "zipped").mkdir()
    with zipfile.ZipFile(tmp_path / "zipped/all.zip", "w") as z:
        z.writestr("d/001GEN.usx", USX)
    for folder in ("plain", "zipped"):
        got = text.read_usx(spark, f"{tmp_path}/{folder}").orderBy("seq").collect()
        assert [(r["book_id"], r["chapter_num"], r["verse_str"], r["script_text"]) for r in got] == want


def test_scripts_and_headings(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Book,CP,Verse_Number,Reader,Text,Other\njms,1,<<,Al,Title,z\nJAS,1,2a,Al,\"a, b\",z\n")
    rows = text.read_csv_script(spark, str(tmp_path / "s.csv")).collect()
    assert [(r["book_id"], r["chapter_num"], r["verse_str"], r["script_text"]) for r in rows] == [("JAS", 1, "0", "Title"), ("JAS", 1, "2a", "a, b")]
    with pytest.raises(ValueError):
        text.resolve_headers(spark.createDataFrame([(1,)], "foo int"))
    (tmp_path / "p.json").write_text(json.dumps({"data": [{"book_id": "GEN", "chapter": c, "verse_start": v, "verse_end": v, "verse_text": f"&lt{c}:{v}"} for c, v in ((2, "1"), (1, "10"), (1, "2"))]}))
    books = spark.createDataFrame([("GEN", 1)], "book_id string, book_seq int")
    lines = text.read_plain_json(spark, str(tmp_path / "p.json"), books)
    assert [r["script_text"] for r in lines.orderBy("script_num").collect()] == ["<1:2", "<1:10", "<2:1"]
    titles = spark.createDataFrame([("GEN", "Genesis")], "book_id string, script_text string")
    heads = spark.createDataFrame([("GEN", 1, "One"), ("GEN", 2, "Two")], "book_id string, chapter_num int, script_text string")
    got = text.add_headings(lines, titles, heads).orderBy("script_num").collect()
    assert [r["script_text"] for r in got] == ["Genesis", "<1:2", "<1:10", "Two", "<2:1"]


def test_timings(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("0.5\t2.0\t001\n2.0\t3.0\t002\n")
    assert [(r["verse_str"], r["begin_ts"], r["end_ts"]) for r in timing.read_timing_tsv(spark, str(tmp_path / "t.tsv")).orderBy("verse_str").collect()] == [("0", 0.0, 0.5), ("1", 0.5, 2.0), ("2", 2.0, 3.0)]
    (tmp_path / "a.json").write_text(json.dumps({"ratio": 0.02, "dictionary": {"a": 1, "b": 2}, "tokens": [[[1, 0, 5, 0.9], [2, 5, 9, 0.8]], [[2, 10, 11, 0.7]]]}))
    got = [(r["word"], r["seq"], r["label"], round(r["begin_ts"], 2)) for r in timing.read_tokens(spark, str(tmp_path / "a.json")).collect()]
    assert got == [(0, 0, "a", 0.0), (0, 1, "b", 0.1), (1, 0, "b", 0.2)]
    (tmp_path / "w.json").write_text(json.dumps({"segments": [{"id": 0, "start": 0.00049, "end": 1.5, "text": " hi "}]}))
    assert timing.read_segments(spark, str(tmp_path / "w.json")).select("begin_ts", "end_ts", "text").first() == (0.0, 1.5, "hi")
    (tmp_path / "f.json").write_text(json.dumps({"fragments": [{"id": "f1", "begin": "1.25", "end": "x", "lines": []}]}))
    assert timing.read_fragments(spark, str(tmp_path / "f.json")).select("id", "begin_ts", "end_ts").first() == (None, 1.25, None)


def test_flattened_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0, 0.1, [[1.0, 2.0], [3.0, 4.0]]), (2, "", 0, 0.0, [])], "id int, t string, zero int, x double, m array<array<double>>")
    got = [tuple(r) for r in sinks.flatten(df.drop("zero", "x"), "m").orderBy(F.col("id").asc_nulls_last(), "m0").collect()]
    assert got == [(1, "a", 1.0, 2.0), (2, "", None, None), (None, None, 3.0, 4.0)]
    assert sinks.active_columns(df) == ["id", "t", "x", "m"]
    sinks.write_csv(df, str(tmp_path / "c"), matrix="m")
    back = spark.read.csv(str(tmp_path / "c"), header=True)
    assert back.columns == ["id", "t", "x", "m0", "m1"] and back.count() == 3
    sinks.write_html(df, ["id", "t"], str(tmp_path / "h"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "h")).collect()) == ["<tr><td>1</td><td>a</td></tr>", "<tr><td>2</td><td></td></tr>"]


def test_store(spark, tmp_path):
    data = Dataset(spark, f"file://{tmp_path}/d")
    assert data.write("t", spark.range(3)) == 1
    assert data.change("t", lambda df: df.filter("id > 0")) == 2
    assert (data.read("t").count(), data.read("t", 1).count()) == (2, 3)
    assert data.clone("_audio").read("t").count() == 2
    with pytest.raises(KeyError):
        data.read("none")


def test_requests():
    good = decode({"dataset_name": "d", "bible_id": "engweb", "text_data": "usx", "text_path": "p", "compare": {"base_dataset": "b", "quotes": "remove"}})
    assert (good.bible_id, good.language_iso, good.compare.quotes) == ("ENGWEB", "eng", "remove")
    with pytest.raises(RequestError, match="unknown field nope"):
        decode({"nope": 1})
    with pytest.raises(RequestError) as e:
        decode({"text_data": "word", "compare": {"hyphens": "x"}})
    assert len(str(e.value).splitlines()) >= 5


def test_request_end_to_end(spark, tmp_path):
    for name, change in (("base", ""), ("comp", "made.")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "001GEN.usx").write_text(USX.replace("made.", "created.") if change else USX)
        r = {"dataset_name": name, "bible_id": "ENGWEB", "text_data": "usx", "text_path": f"{tmp_path}/{name}", "detail": "both"}
        if change:
            r |= {"compare": {"base_dataset": "base", "lower_case": True, "diacritics": "nfc"}, "output_csv": f"{tmp_path}/csv"}
        tables = pipeline.execute(spark, decode(r), f"file://{tmp_path}/store")
    assert tables["words"].filter("ttype = 'W'").count() == 7
    assert [(p["verse_str"], p["base_text"], p["comp_text"]) for p in tables["pairs"].collect()] == [("2-3", "made.", "created.")]
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 3


def test_queue(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"dataset_name": "d", "bible_id": "B", "text_data": "usx", "text_path": "p"}))
    (tmp_path / "in/b.json").write_text(json.dumps({"wrong": 1}))
    seen = []
    queue.serve(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", lambda r: seen.append(r.dataset_name), once=True).awaitTermination(60)
    rows = spark.read.json(f"{tmp_path}/out/*").collect()
    assert seen == ["d"] and sorted(r["status"] for r in rows) == ["failed", "success"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = queue.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    streamed = {tuple(r)[:3] for r in spark.table("counts").collect()}
    assert streamed == {tuple(r)[:3] for r in queue.windowed_counts(events).collect()} and streamed
    q = queue.running_gaps(stream).writeStream.outputMode("update").format("memory").queryName("gaps").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("gaps").agg(F.sum("n")).first()[0] == events.count()


def test_rounded_zeros_keep_their_sign(spark, tmp_path):
    """As the queries' SQL rounds: values just below a group's mean are -0.0."""
    rows = [(i, [x], 1) for i, x in enumerate([-1e-9, 1e-9, 0.0, 2.0, -2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["zscores"][0] for r in registry.QUERIES["zscore_cols"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {i: z[0] for i, _, z in con.sql(registry.ORACLES["zscore_cols"]).fetchall()}
    assert {i: str(z) for i, z in got.items()} == {i: str(z) for i, z in want.items()} and str(got[0]) == "-0.0"
