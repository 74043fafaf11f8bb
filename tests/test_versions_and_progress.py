"""Versions merged when read, and counters that a pass gathers itself."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import reports
from quillspark.sources.versions import Versions
from quillspark.streaming import events
from quillspark.streaming.progress import Listener, Progress


@pytest.fixture
def versions(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/versions", "id string, title string")


def _put(spark, table, *rows):
    table.append(spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "id string, title string, at int"), "at")


def test_versions(spark, versions):
    assert versions.newest(3).count() == versions.current().count() == versions.newest_current(3).count() == 0
    versions.compact()
    _put(spark, versions, ("a", "1"), ("b", "1"), ("a", "2"))
    _put(spark, versions)  # no rows: no part
    _put(spark, versions, ("b", "3"), (None, "note"), ("c", None))
    _put(spark, versions, ("b", "4"))
    number, parts = versions.parts()
    assert number == 3 and [(p.lo, p.hi, p.n) for p in parts] == [(1, 3, 3), (4, 6, 3), (7, 7, 1)]
    rows = lambda df: [tuple(r) for r in df.select("id", "title", "seq").collect()]
    assert rows(versions.newest(2)) == [("b", "4", 7), ("c", None, 6)] and len(rows(versions.newest(100))) == 7
    assert {p.rsplit("/", 1)[0] for p in versions.newest(2).inputFiles()} == {f"{versions.path}/{p.path}" for p in parts[1:]}
    assert rows(versions.newest_current(2)) == [("b", "4", 7), ("c", None, 6)]
    assert rows(versions.newest_current(9)) == [("b", "4", 7), ("c", None, 6), ("a", "2", 3)]
    assert sorted(rows(versions.current())) == [("a", "2", 3), ("b", "4", 7), ("c", None, 6)]

    before = rows(versions.log().orderBy("seq"))
    versions.compact(per=2)
    assert [(p.n, p.hi) for p in versions.parts()[1]] == [(2, 5), (2, 7)]
    assert rows(versions.log().orderBy("seq")) == [r for r in before if r[2] in (3, 5, 6, 7)]
    assert len(versions.newest(1).inputFiles()) < len(versions.log().inputFiles())
    _put(spark, versions, ("a", "8"))
    assert rows(versions.newest_current(2)) == [("a", "8", 8), ("b", "4", 7)]


def test_a_broken_append_changes_nothing(spark, versions):
    _put(spark, versions, ("a", "1"))
    seen = versions.log()
    fails = spark.createDataFrame([("b", "2", 0)], "id string, title string, at int").withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        versions.append(fails, "at")
    assert versions.parts()[0] == 1 and versions.log().count() == 1
    number, parts = versions.parts()
    _put(spark, versions, ("b", "2"))
    with pytest.raises(Exception, match="[Ee]xist"):  # a writer that began at the state before
        versions._enter(number + 1, parts)
    assert versions.log().count() == 2 and seen.count() == 1


LOG = "t timestamp, e string, p string, rest map<string,string>"


def _events(spark, *rows):
    return spark.createDataFrame([(None, e, p, rest) for e, p, rest in rows], LOG).withColumn("t", F.lit("2024-01-01").cast("timestamp"))


ROWS = [("phase_start", "A", None), ("item_scored", "A", {"tokens_in": "5", "tokens_out": "2"}), ("item_error", "A", {}), ("error", "B", {"tokens_in": "x"}), ("phase_end", "A", None), ("phase_start", "B", {}), ("item_scored", None, {}), ("other", "B", {}), ("item_scored", "Z", {})]


def test_counters_of_a_batch_are_those_of_the_log(spark, tmp_path):
    rows = _events(spark, *ROWS, (None, "A", {}))
    progress = Progress(("A", "B", "C"))
    assert [r["status"] for r in progress.report()] == ["pending"] * 3
    progress.write(rows, f"file://{tmp_path}/rows")
    want = {r.p: r for r in reports.phase_counters(rows).collect()}
    for r in progress.table(spark).where("p <> 'C'").collect():
        assert all(r[k] == want[r.p][k] for k in ("started", "ended", "scored", "errors", "degradations", "tokens", "status"))
    assert progress.events == 10 == spark.read.parquet(f"file://{tmp_path}/rows").count()
    progress.write(rows.limit(0), f"file://{tmp_path}/rows")
    assert progress.events == 10
    broken = rows.withColumn("e", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        progress.write(broken, f"file://{tmp_path}/rows")
    assert progress.events == 10


def test_counters_of_a_stream_go_on_from_its_checkpoint(spark, tmp_path):
    progress, path = Progress(("A", "B"), name="stream-counters"), f"file://{tmp_path}"
    listener = Listener(progress)
    spark.streams.addListener(listener)
    try:
        for some in (ROWS[:4], ROWS[4:], []):
            if some:
                events.append(_events(spark, *some), f"{path}/log")
            live = progress.watched(events.read(spark, f"{path}/log", stream=True, files=1))
            listener.wait(events.to_table(live, f"{path}/rows", f"{path}/state"))
            assert progress.events == spark.read.parquet(f"{path}/rows").count()
    finally:
        spark.streams.removeListener(listener)
    a, b = progress.report()
    assert (a["started"], a["ended"], a["scored"], a["errors"], a["tokens"], a["status"]) == (1, 1, 1, 1, 7, "done_with_errors")
    assert (b["started"], b["errors"], b["status"]) == (1, 1, "running")
