"""Pairs of papers and of siblings: all of them, with no more sent or compared than that takes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph, ontology


@pytest.mark.parametrize(("width", "blocks"), [(1, 4), (7, 3), (256, 64)])
def test_a_paper_is_in_few_tiles(spark, monkeypatch, width, blocks):
    monkeypatch.setattr(graph, "WIDTH", width)
    monkeypatch.setattr(graph, "BLOCKS", blocks)
    k = 41
    best = spark.range(1, k + 1).select(F.col("id").cast("string").alias("i"), F.lit(0.5).alias("s"), F.col("id").alias("rn"))
    for side in graph.tiles(best):
        assert side.count() <= blocks * k
    got = graph.pairs(spark.range(k).selectExpr("id AS paper_id", "1 - id / 100 AS dry_score", "id AS pos")).collect()
    assert sorted((int(r.source_id), int(r.target_id)) for r in got) == list(itertools.combinations(range(k), 2))


@pytest.mark.parametrize("size", [1, 3, 1024])
def test_words_are_compared_once_a_class(spark, monkeypatch, size):
    monkeypatch.setattr(ontology, "SLICE", size, raising=False)
    draw = random.Random(9)
    rows = [(f"n{i}", draw.choice(["aa bb cc", "aa bb", "dd ee", "aa bb cc ff"]), ["L1"]) for i in range(60)] + [(None, "aa bb", ["L1"])]
    found = ontology.sibling_pairs(spark.createDataFrame(rows, "id string, title string, knowledge_level array<string>"), 0.6)
    assert "array_union" not in found._jdf.queryExecution().optimizedPlan().toString()  # the join of nodes has similarities, not words
    sets = sorted((i, set(t.split())) for i, t, _ in rows if i)
    want = [("L1", i, j, round(len(s & t) / len(s | t), 3)) for (i, s), (j, t) in itertools.combinations(sets, 2) if len(s & t) / len(s | t) >= 0.6]
    assert sorted(map(tuple, found.collect())) == want


def test_a_paper_is_scored_once_for_its_pairs(spark):
    met = spark.sparkContext.accumulator(0)

    def score(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    scored = spark.range(50).selectExpr("id AS paper_id", "1 - id / 50 AS dry_score", "id AS pos").mapInArrow(score, "paper_id long, dry_score double, pos long")
    assert graph.pairs(scored).count() == 39 * 40 / 2  # 40 papers are above 0.2
    assert met.value == 50
