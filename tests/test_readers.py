"""Readers of alignments, pairs and lists against small files."""

import json

import pytest

from strophe.sources import text, timing


def test_sections(spark, tmp_path):
    sections = [{"verse_id": "1", "timings": [0.5, 2.0], "text": "a", "uroman_tokens": "a"}, {"verse_id": "2", "timings": [2.0, 3.25], "text": "b", "uroman_tokens": "b"}]
    (tmp_path / "a.json").write_text(json.dumps([{"audio_file": "MRK.1.mp3", "sections": sections}, {"audio_file": "other.mp3", "sections": sections}]))
    got = [(r["audio_file"], r["verse_str"], r["begin_ts"], r["end_ts"]) for r in timing.read_sections(spark, str(tmp_path / "a.json")).orderBy("begin_ts").collect()]
    assert got == [("MRK.1.mp3", "1", 0.5, 2.0), ("MRK.1.mp3", "2", 2.0, 3.25)]
    (tmp_path / "b.json").write_text(json.dumps([{"audio_file": "x", "sections": [{"verse_id": "7", "timings": [1.0], "text": ""}]}]))
    with pytest.raises(Exception, match="missing timestamps for 7"):
        timing.read_sections(spark, str(tmp_path / "b.json")).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text("\n".join(json.dumps({"audio_start_sec": s, "duration": d}) for s, d in ((0.0004, 1.0), (1.0006, 2.0))) + "\n")
    references = spark.createDataFrame([(0, 70), (1, 71)], "seq int, script_id long")
    got = [tuple(r) for r in timing.read_manifest(spark, str(tmp_path / "m.json"), references).orderBy("script_id").collect()]
    assert got == [(70, 0.0, 1.0), (71, 1.001, 3.001)]
    with pytest.raises(ValueError, match="2 lines for 1"):
        timing.read_manifest(spark, str(tmp_path / "m.json"), references.limit(1))


def test_verse_pieces(spark):
    segments = spark.createDataFrame([("f", 0, 0.5, 1.0, "one"), ("f", 1, 1.0, 2.5, "two")], "file string, id long, begin_ts double, end_ts double, text string")
    pieces = spark.createDataFrame([("f", "3", 10.0), ("g", "4", 20.0)], "file string, verse_str string, piece_begin double")
    assert [tuple(r) for r in timing.verse_pieces(segments, pieces).collect()] == [("f", "3", ["one", "two"], 10.5, 12.5)]


def test_known_errors_and_pairs(spark, tmp_path):
    (tmp_path / "e.csv").write_text('MRK 1:2, 4 , word ,missing\n"MRK 1:3",x,"a, b",extra\n')
    got = sorted(tuple(r) for r in text.read_known_errors(spark, str(tmp_path / "e.csv")).collect())
    assert got == [("MRK 1:2", 4, "word", "missing"), ("MRK 1:3", 0, "a, b", "extra")]
    rows = [{"ref": {"book_id": b, "chapter_num": c, "verse_str": "1"}, "base": {"script_id": i, "text": "t"}, "comp": {"script_id": i + 100, "text": "u"}, "diffs": [{"Type": -1, "Text": "t"}]} for b, c, i in (("MRK", 1, 1), ("MRK", 2, 0), ("JHN", 1, 3))]
    (tmp_path / "p.json").write_text(json.dumps(rows))

    def ids(*of):
        return sorted(r["script_id"] for r in text.read_pairs(spark, str(tmp_path / "p.json"), *of).collect())

    assert ids() == [1, 3, 100] and ids("MRK") == [1, 100] and ids("MRK", 2) == [100]


def test_paths(spark):
    assert text.fileset_globs("/d", "ENGWEB", "audio", "OTSET", "NTSET") == ["/d/ENGWEB/OTSET/A*.mp3", "/d/ENGWEB/NTSET/B*.mp3"]
    assert text.fileset_globs("/d", "ENGWEB", "text_plain", new="NT") == ["/d/ENGWEB/NT.json"] and text.fileset_globs("/d", "E", "text_usx_edit", "OT") == ["/d/E/OT/*.usx"]
    listing = spark.createDataFrame([("p/M1/core_script/a",), ("p/M1/aeneas_verse_timings/a",), ("p/M1/aeneas_verse_timings/b",), ("p/M2/other/x",)], "path string")
    got = {r["media_id"]: tuple(r)[1:] for r in text.artefact_paths(listing, spark.createDataFrame([("M1",), ("M2",)], "media_id string")).collect()}
    assert got == {"M1": ("p/M1/core_script/", "", "", "p/M1/aeneas_verse_timings/", 2), "M2": ("", "", "", "", 0)}
