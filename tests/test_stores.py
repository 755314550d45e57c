"""Commits over several tables with two writers, the paginated source, alarms while runs go on."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from strophe.ledger import Conflict, Ledger
from strophe.sources.paged import paged_source, paging
from strophe.streaming import alarm, queue


@pytest.fixture
def ledger(spark, tmp_path):
    own = Ledger(spark, f"file://{tmp_path}/ledger")
    change = own.begin()
    change.replace("t", rows(spark, [("GEN", 1, 1), ("GEN", 2, 2), ("EXO", 1, 3), (None, 1, 4)]), ["book", "chapter"])
    change.replace("u", rows(spark, [("GEN", 1, 10)]), ["book"])
    assert change.commit() == 1
    return own


def rows(spark, values):
    return spark.createDataFrame(values, "book string, chapter int, x long")


def values(ledger, table, version=None):
    return sorted(r["x"] for r in ledger.read(table, version).collect())


def test_replace_and_history(spark, ledger):
    assert (ledger.tables(), values(ledger, "t"), values(ledger, "u")) == (["t", "u"], [1, 2, 3, 4], [10])
    kept = {json.dumps(p) for p in ledger.state()["t"]["parts"]}
    change = ledger.begin()
    change.replace("t", rows(spark, [("GEN", 1, 100), (None, 1, 40)]), ["book", "chapter"], clear=[("EXO", 1), ("LEV", 9)])
    assert values(ledger, "t") == [1, 2, 3, 4]
    assert change.commit() == 2
    assert values(ledger, "t") == [2, 40, 100] and values(ledger, "t", 1) == [1, 2, 3, 4] and values(ledger, "u") == [10]
    # the untouched chapter is the same folder as before
    assert len(kept & {json.dumps(p) for p in ledger.state()["t"]["parts"]}) == 1
    empty = ledger.begin()
    empty.replace("u", rows(spark, []), ["book"], clear=[("GEN",)])
    empty.commit()
    assert values(ledger, "u") == [] and ledger.read("u").columns == ["book", "chapter", "x"]
    with pytest.raises(KeyError):
        ledger.read("none")
    with pytest.raises(ValueError, match="parts by"):
        ledger.begin().replace("t", rows(spark, []), ["book"])


def test_two_writers_of_one_chapter(spark, ledger):
    a, b = ledger.begin(), ledger.begin()
    a.replace("t", rows(spark, [("GEN", 1, 5)]), ["book", "chapter"])
    b.replace("t", rows(spark, [("GEN", 1, 6)]), ["book", "chapter"])
    b.replace("u", rows(spark, [("GEN", 1, 60)]), ["book"])
    assert a.commit() == 2
    with pytest.raises(Conflict):
        b.commit()
    assert values(ledger, "t") == [2, 3, 4, 5] and values(ledger, "u") == [10] and ledger.version() == 2


def test_writers_of_different_chapters_both_win(spark, ledger):
    a, b = ledger.begin(), ledger.begin()
    a.replace("t", rows(spark, [("GEN", 1, 5)]), ["book", "chapter"])
    b.replace("t", rows(spark, [("GEN", 2, 6)]), ["book", "chapter"])
    assert (b.commit(), a.commit()) == (2, 3)
    assert values(ledger, "t") == [3, 4, 5, 6]


def test_one_number_is_given_once(ledger):
    won = []
    threads = [threading.Thread(target=lambda: won.append(ledger._put(7, {"tables": {}, "touched": []}))) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 5 + [True]


def test_the_loser_runs_again_and_readers_see_no_half(spark, ledger):
    """Two writers add to a chapter at once while a reader looks: every commit keeps both tables in step."""
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            v = ledger.version()
            seen.append((values(ledger, "t", v), values(ledger, "u", v)))

    def add(change):
        x = change.read("t").filter("book = 'GEN' and chapter = 1").agg(F.max("x")).first()[0] + 1
        change.replace("t", rows(spark, [("GEN", 1, x)]), ["book", "chapter"])
        change.replace("u", rows(spark, [("GEN", 1, 10 * x)]), ["book"])

    reader = threading.Thread(target=read)
    writers = [threading.Thread(target=lambda: [ledger.run(add, 20) for _ in range(3)]) for _ in range(2)]
    for t in (reader, *writers):
        t.start()
    for t in writers:
        t.join()
    stop.set()
    reader.join()
    assert values(ledger, "t") == [2, 3, 4, 7] and values(ledger, "u") == [70] and ledger.version() == 7
    assert seen and all(u == [10 * next(x for x in t if x not in (2, 3, 4) or t.count(x) > 1 or len(t) < 4)] for t, u in seen if set(t) > {2, 3, 4} and len(t) == 4 and u[0] > 40)


def pages(tmp_path, n, wrong=None):
    for i in range(1, n + 1):
        place = {"current_page": wrong.get(i, i) if wrong else i, "total_pages": n}
        (tmp_path / f"page-{i}.json").write_text(json.dumps({"data": [{"id": 10 * i + k, "name": f"n{i}"} for k in range(i)], "meta": {"pagination": place}}))
    return f"file://{tmp_path}"


def test_pages_are_partitions(spark, tmp_path):
    spark.dataSource.register(paged_source("pages_test"))
    df = spark.read.format("pages_test").schema("name string, id long, other double").load(pages(tmp_path, 4))
    assert df.rdd.getNumPartitions() == 4
    assert sorted(r["id"] for r in df.collect()) == [10, 20, 21, 30, 31, 32, 40, 41, 42, 43]
    assert {r["name"] for r in df.collect()} == {"n1", "n2", "n3", "n4"} and {r["other"] for r in df.collect()} == {None}


def test_missing_and_wrong_pages_raise(spark, tmp_path):
    spark.dataSource.register(paged_source("pages_test"))
    place = pages(tmp_path, 3, {2: 3})
    with pytest.raises(Exception, match="gave page 3 for page 2"):
        spark.read.format("pages_test").schema("id long").load(place).collect()
    (tmp_path / "page-2.json").unlink()
    with pytest.raises(Exception, match="page-2.json"):
        spark.read.format("pages_test").schema("id long").load(place).collect()
    assert paging('{"data": [], "meta": {"pagination": {"current_page": 1, "total_pages": 0}}}', 1, "x") == ([], 0)


def test_a_slow_request_raises_its_alarm_while_it_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("slow", "quick"):
        (tmp_path / f"in/{name}.json").write_text(json.dumps({"dataset_name": name, "bible_id": "B", "text_data": "usx", "text_path": "p"}))
    told, done = [], []

    def work(request):
        if request.dataset_name == "slow":
            while not told:
                time.sleep(0.02)
        done.append((request.dataset_name, list(told)))

    q = queue.serve(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", work, once=True, late=lambda r, minutes: told.append((r.dataset_name, minutes)), allowed=lambda r: 0.01)
    q.awaitTermination(120)
    assert dict(done)["slow"][0] == ("slow", 0.01) and [n for n, _ in told].count("slow") == 1
    assert {r["status"] for r in spark.read.json(f"{tmp_path}/out/*").collect()} == {"success"}


def test_minutes():
    assert alarm.minutes_allowed(False, False, False, False) == 20 and alarm.minutes_allowed(True, True, True, False) == 580
    assert alarm.minutes_allowed(True, False, False, True) == pytest.approx(9)


def test_keyed_timers(spark, tmp_path):
    schema = "run string, kind string, minutes double"
    (tmp_path / "e").mkdir()

    def add(name, *events):
        (tmp_path / f"e/.{name}").write_text("".join(json.dumps(dict(zip(("run", "kind", "minutes"), e, strict=True))) + "\n" for e in events))
        (tmp_path / f"e/.{name}").rename(tmp_path / f"e/{name}.json")

    add("a", ("late", "start", 0.02), ("done", "start", 0.02), ("done", "end", None), ("long", "start", 600.0))
    q = alarm.late_runs(spark.readStream.schema(schema).json(f"{tmp_path}/e")).writeStream.outputMode("append").format("memory").queryName("late_runs").trigger(processingTime="500 milliseconds").start()
    until = time.time() + 60
    while time.time() < until and not spark.table("late_runs").count():
        time.sleep(0.3)
    add("b", ("long", "end", None))
    time.sleep(2)
    q.stop()
    assert [tuple(r) for r in spark.table("late_runs").collect()] == [("late", 0.02)]


def test_many_pages_share_partitions(spark, tmp_path):
    """Tasks do not grow with the pages: runs of pages, each row once, and every page still checked."""
    spark.dataSource.register(paged_source("pages_test"))
    place = pages(tmp_path, 300)
    df = spark.read.format("pages_test").schema("id long").load(place)
    assert df.rdd.getNumPartitions() == 256
    few = spark.read.format("pages_test").schema("id long").option("parts", "7").load(place)
    assert few.rdd.getNumPartitions() == 7
    assert sorted(r["id"] for r in few.collect()) == sorted(10 * i + k for i in range(1, 301) for k in range(i))
    (tmp_path / "page-299.json").unlink()
    with pytest.raises(Exception, match="page-299.json"):
        few.collect()
