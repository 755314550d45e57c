"""USX titles and styles, language tables, line files and status reports against small files."""

import csv
import glob
import json

import pytest

from strophe.operators import joins, language
from strophe.sources import languages, sinks, text

USX = """<usx version="3.0"><book code="JON" style="id">Jonah</book><para style="h">Jonah</para><para style="mt2">The Book of</para><para style="mt1">Jonah</para>
<chapter number="1" style="c"/><para style="p"><verse number="1"/>One.<verse number="2"/>Two.</para><para style="zz9">Not text.</para><para style="q12">Two digits.</para>
<chapter number="2" style="c"/><para style="q2"><verse number="1"/>Three.</para></usx>"""


def test_usx_headings(spark, tmp_path):
    (tmp_path / "a.usx").write_text(USX)
    lines = text.read_usx(spark, str(tmp_path))
    titles = text.read_usx_titles(spark, str(tmp_path))
    assert [tuple(r) for r in titles.collect()] == [("JON", "Jonah", "The Book of Jonah")]
    got = [tuple(r) for r in text.add_usx_headings(lines, titles).orderBy("chapter_num", "script_num").collect()]
    assert got == [
        ("JON", 1, 1, "0", "para.mt", "The Book of Jonah"), ("JON", 1, 2, "1", "p", "One."), ("JON", 1, 3, "2", "p", "Two."),
        ("JON", 2, 1, "0", "para.h", "Jonah 2"), ("JON", 2, 2, "1", "q2", "Three."),
    ]
    assert text.add_usx_headings(lines.limit(0), titles).collect() == []


def test_usx_styles(spark, tmp_path):
    (tmp_path / "a.usx").write_text(USX)
    got = {r["style"]: (r["n"], r["in_verses"]) for r in text.read_usx_styles(spark, str(tmp_path)).collect()}
    assert got == {"h": (1, True), "mt2": (1, True), "mt1": (1, True), "p": (1, True), "zz9": (1, False), "q12": (1, False), "q2": (1, True)}
    assert [text.in_verses(s) for s in ("p", "q3", "q12", "", "7", "x")] == [True, True, False, False, False, False]


def test_language_tables(spark, tmp_path):
    head = ",".join(f"c{i}" for i in range(15))
    rows = [["a1", "f", "", 'An, "old" one', "False", "language", "", "", "aaa", "", "", "", "", "", "US"], ["b1", "f", "a1", "Bee", "True", "dialect", "", "", "bbb"] + [""] * 6, ["c1", "f", "a1", "Cee", "False", "dialect"] + [""] * 9]
    with (tmp_path / "g.tab").open("w", newline="") as f:
        f.write(head + "\n")
        csv.writer(f, lineterminator="\n").writerows(rows)
    (tmp_path / "iso.tab").write_text("Id\tb\tt\tPart1\naaa\t\t\taa\nddd\t\t\t\n")
    (tmp_path / "tool.tab").write_text("aa,Tool A\nxyz,Tool X\n")
    g, codes, tool = languages.read_languoids(spark, str(tmp_path / "g.tab")), languages.read_iso_codes(spark, str(tmp_path / "iso.tab")), languages.read_tool(spark, str(tmp_path / "tool.tab"), 0, 1)
    full = {r["glotto_id"]: r for r in languages.with_short_codes(g, codes).collect()}
    assert (full["a1"]["name"], full["a1"]["iso1"], full["a1"]["country_ids"], full["a1"]["bookkeeping"]) == ('An, "old" one', "aa", "US", False)
    assert (full["b1"]["bookkeeping"], full["b1"]["iso1"], full["c1"]["iso3"]) == (True, "", "")
    got = sorted(tuple(r) for r in languages.unknown_codes(g, codes, {"tool": tool}).collect())
    assert got == [("not in catalogue", "ddd", ""), ("not in list", "bbb", ""), ("tool", "xyz", "Tool X")]
    assert {r["glotto_id"]: r["code"] for r in language.tool_codes(languages.with_short_codes(g, codes), tool, "code").collect()} == {"a1": "aa", "b1": "", "c1": ""}


def test_line_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"line {i}") for i in range(500)] + [(500, None)], "i int, t string").repartition(7)
    sinks.write_lines(df, "t", str(tmp_path / "out"), ["i"])
    got = [x for f in sorted(glob.glob(f"{tmp_path}/out/part-*")) for x in open(f).read().split("\n")[:-1]]
    assert got == [f"line {i}" for i in range(500)] + [""]


def test_status(spark, tmp_path):
    status = {"status": 500, "message": "it failed", "error": 'say "no", twice', "trace": "deep"}
    sinks.write_status(spark, str(tmp_path / "c"), status, "csv", trace=True)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True, escape='"').collect()] == [("status", "500"), ("message", "it failed"), ("error", 'say "no", twice'), ("request", None), ("trace", "deep")]
    sinks.write_status(spark, str(tmp_path / "j"), status)
    (file,) = glob.glob(f"{tmp_path}/j/part-*")
    assert json.load(open(file)) == {"status": "500", "message": "it failed", "error": 'say "no", twice', "request": ""}
    with pytest.raises(ValueError, match="csv or json"):
        sinks.write_status(spark, str(tmp_path / "x"), status, "xml")


def test_repeated_changes_raise(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match="repeat a key"):
        joins.upsert(target, spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string"), ["k"])
