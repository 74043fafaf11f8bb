"""Retrieval in tiles: pairs of papers are never rows, whatever the frequencies of words."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.operators import seeds

ROW = pa.schema([("id", pa.int64()), ("w", pa.list_(pa.string())), ("l", pa.list_(pa.int32()))])


def _table(rows):
    return pa.Table.from_pylist([dict(zip(("id", "w", "l"), r, strict=True)) for r in rows], ROW)


def test_pairs_are_not_rows(spark):
    papers = spark.range(400).select(F.col("id").alias("paper_id"), F.concat(F.lit("noise control of "), F.col("id").cast("string")).alias("title"), F.array(F.lit("L1-x")).alias("knowledge_level"))
    found = seeds.retrieve(papers.where("paper_id % 100 = 0"), papers, common=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate" in plan and "array_intersect" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r.new_id, []).append((r["rank"], r.paper_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i + 1, x) for i, x in enumerate([x for x in range(16) if x != k][:15])] for k in (0, 100, 200, 300)}


def test_a_tile_gives_the_best_and_the_smallest_of_equals():
    known = _table([(9, ["noise"], [1]), (3, ["noise"], [1]), (7, ["noise"], [1]), (1, None, []), (2, ["plate", "noise"], [6]), (4, [], None)])
    new = _table([(7, ["noise"], [1]), (50, [], []), (60, ["other"], [2])])
    got = [(r["new_id"], r["paper_id"], round(r["relevance"], 3)) for r in seeds._nearest(new, known, 2).to_pylist()]
    assert sorted(got) == [(7, 3, 1.0), (7, 9, 1.0), (50, 1, 0.0), (50, 2, 0.0), (60, 3, 0.425), (60, 7, 0.425)]
    assert seeds._nearest(new, known.slice(0, 0), 2).num_rows == seeds._nearest(new.slice(0, 0), known, 2).num_rows == 0
    assert seeds._nearest(_table([(1, ["a"], [1])]), _table([(1, ["a"], [1])]), 2).num_rows == 0  # itself only
