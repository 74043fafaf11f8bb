"""Sinks and streams that break off: all or nothing, and once whatever happens."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators import render
from quillspark.sources import notes
from quillspark.streaming import events as stream
from quillspark.streaming.results import Results

NAMED = "name string, text string"


def test_notes_are_files(spark, tmp_path):
    rows = [("papers/a b+c.md", "text\nof a"), ("papers/é.md", ""), ("top.md", None), ("00-meta/deep/x.md", "y" * 100_000)]
    path = f"file://{tmp_path}/vault"
    notes.write(spark.createDataFrame(rows, NAMED).repartition(3), path)
    assert sorted((r.name, r.text) for r in notes.read(spark, path).collect()) == sorted((n, t) for n, t in rows if t)
    assert sorted(os.path.relpath(f"{d}/{f}", f"{tmp_path}/vault") for d, _, fs in os.walk(f"{tmp_path}/vault") for f in fs) == sorted(n for n, _ in rows)
    assert sorted(os.listdir(tmp_path)) == ["vault"] and not [f for _, _, fs in os.walk(tmp_path) for f in fs if f.startswith(".") and not f.endswith(".crc")]
    notes.write(spark.createDataFrame([("only.md", "z")], NAMED), path)  # the old ones go
    assert [tuple(r) for r in notes.read(spark, path).collect()] == [("only.md", "z")]
    with pytest.raises(Exception, match="there already"):
        notes.write(spark.createDataFrame([("more.md", "z")], NAMED), path, overwrite=False)
    notes.write(spark.createDataFrame([], NAMED), f"file://{tmp_path}/none")
    assert os.listdir(f"{tmp_path}/none") == []


@pytest.mark.parametrize("bad", [[("a.md", "1"), ("a.md", "2")], [("../up.md", "x")], [(None, "x")], [("", "x")]])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    path = f"file://{tmp_path}/vault"
    notes.write(spark.createDataFrame([("kept.md", "old")], NAMED), path)
    with pytest.raises(Exception, match="name"):
        notes.write(spark.createDataFrame([*bad, *((f"n{i}.md", "x") for i in range(30))], NAMED), path)
    assert sorted(os.listdir(tmp_path)) == ["vault"] and os.listdir(f"{tmp_path}/vault") == ["kept.md"]


def test_plain_notes_need_no_graph(spark):
    papers = spark.createDataFrame([("p/1", 'a "t"', None, "text"), ("2", None, 2020, None)], "paper_id string, title string, year int, abstract string")
    got = {r.name: r.text for r in render.plain_notes(papers, spark.createDataFrame([("2", 0.25)], "paper_id string, dry_score double")).collect()}
    assert len(got) == 2 and any("b1: 0.2500" in t and "year: 2020" in t for t in got.values()) and any('title: "a \\"t\\""' in t for t in got.values())


def _work(rows):
    return rows.select("paper_id", (F.col("paper_id") * 2.0).alias("mean_score"))


def test_results_of_a_stream_that_breaks_off(spark, tmp_path, monkeypatch):
    papers, kept = f"file://{tmp_path}/papers", Results(spark, f"file://{tmp_path}/results", "paper_id long, mean_score double")
    assert kept.read().count() == 0 and kept.ledger().count() == 0
    for at in range(4):
        spark.range(at * 10, at * 10 + 15).select(F.col("id").alias("paper_id")).coalesce(1).write.mode("append").parquet(papers)  # neighbours overlap
    live = lambda: spark.readStream.schema("paper_id long").option("maxFilesPerTrigger", 1).parquet(papers)
    state, enter = f"file://{tmp_path}/state", Results._enter

    def lost(self, batch, n):
        if batch == 1:
            raise RuntimeError("lost before the ledger")  # the rows of the batch are there already
        enter(self, batch, n)

    monkeypatch.setattr(Results, "_enter", lost)
    with pytest.raises(Exception, match="lost before"):
        kept.follow(live(), state, _work).awaitTermination()
    assert kept.ledger().count() == 1 and kept.read().count() == 15
    monkeypatch.setattr(Results, "_enter", enter)
    kept.follow(live(), state, _work).awaitTermination()
    assert sorted(map(tuple, kept.read().collect())) == [(i, 2.0 * i) for i in range(45)]
    before = sorted(map(tuple, kept.ledger().collect()))
    assert sum(n for _, n in before) == 45
    kept.put(spark.range(500, 510).select(F.col("id").alias("paper_id")), 2, _work)  # a batch that the ledger has
    kept.put(spark.range(5).select(F.col("id").alias("paper_id")), 9, _work)  # papers that have a result
    assert kept.read().count() == 45 and sorted(map(tuple, kept.ledger().collect())) == [*before, (9, 0)]


def test_a_stream_cut_between_batches_loses_and_doubles_nothing(spark, tmp_path):
    log, out, state = (f"file://{tmp_path}/{x}" for x in ("log", "rows", "state"))
    for at in range(4):
        spark.range(at * 10, at * 10 + 10).select(F.to_json(F.struct(F.lit("2024-01-01T00:00:00Z").alias("t"), F.lit("e").alias("e"), F.col("id").cast("string").alias("p"))).alias("value")).coalesce(1).write.mode("append").text(log)
    rows = lambda: stream.read(spark, log, stream=True, files=1).select(F.col("p").cast("long").alias("id"))
    broken = rows().withColumn("id", F.when(F.col("id") == 25, F.raise_error(F.lit("cut"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="cut"):
        stream.to_table(broken, out, state).awaitTermination()
    assert 0 < spark.read.parquet(out).count() < 40
    stream.to_table(rows(), out, state).awaitTermination()
    stream.to_table(rows(), out, state).awaitTermination()  # nothing new
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_first_by_time_on_a_stream(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp"
    parts = [
        [(5, 1, "2024-01-01 10:00:00"), (4, 2, "2024-01-01 10:30:00")],
        [(6, 1, "2024-01-01 09:30:00"), (7, 2, "2024-01-01 10:40:00"), (3, 3, "2024-01-01 12:00:00"), (2, 3, "2024-01-01 12:00:00")],  # 1 is corrected; a tie goes to the smaller id
        [(8, 2, "2024-01-01 15:00:00")],
        [(9, 1, "2024-01-01 08:00:00"), (10, 4, "2024-01-01 14:00:00")],  # 1 comes too late, 4 does not
    ]
    got = None
    for rows in parts:
        spark.createDataFrame(rows, "event_id long, user_id long, t string").select("event_id", "user_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events")
        live = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/events")
        stream.to_table(stream.first_by_time(live, ["user_id"]), f"file://{tmp_path}/rows", f"file://{tmp_path}/state").awaitTermination()
        got = {r.user_id: r.event_id for r in stream.settled(spark.read.parquet(f"file://{tmp_path}/rows"), ["user_id"]).collect()}
    assert got == {1: 6, 2: 4, 3: 2, 4: 10}
    whole = spark.read.schema(schema).parquet(f"file://{tmp_path}/events")
    assert {r.user_id: r.event_id for r in stream.first_by_time(whole.where("event_id <> 9"), ["user_id"]).collect()} == got
