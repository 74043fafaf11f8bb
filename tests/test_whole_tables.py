"""Queries over all their rows, where others of the same kind take some."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import seeds
from quillspark.plans import queries


def test_pair_edges_of_more_than_200_papers(spark, sf_dir, monkeypatch):
    scored = spark.range(230).selectExpr("id AS paper_id", "0.3 + id / 1000 AS dry_score", "id AS pos")
    monkeypatch.setattr(queries, "_dry", lambda spark, sf_dir: scored)
    got = queries.QUERIES["pair_edges"](spark, sf_dir)
    assert got.count() == got.distinct().count() == 230 * 229 // 2


def test_retrieval_takes_every_hundredth_paper(spark, sf_dir):
    ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 100 = 0").select("doc_id").collect()}
    assert {r.new_id for r in queries.QUERIES["retrieval_topk"](spark, sf_dir).collect()} == ids


@pytest.mark.parametrize("common", [1, 5, 10**6])
def test_retrieval_is_the_best_of_all_papers(spark, common):
    draw = random.Random(common)
    words = ["Control", "plate", "noise", "ducts", "rooms", "filter", "a", *(f"rare{i}" for i in range(40))]
    rows = [(i, " ".join(draw.choice(words[: draw.choice([5, 7, 47])]) for _ in range(draw.randrange(6))) or None, draw.choice([None, [], ["L1-x"], ["L2-y", "L5-z"], ["none"]])) for i in range(150)]
    rows += [(200 + i, "control of noise", ["L1-x"]) for i in range(40)] + [(None, "control", None)]
    papers = spark.createDataFrame(rows, "paper_id long, title string, knowledge_level array<string>").withColumn("w", F.lit("clash"))
    new = papers.where("paper_id % 4 = 0").withColumn("keywords", F.array(F.lit(" Noise "), F.lit("rare1")))
    long = lambda t: {w.lower() for w in (t or "").split() if len(w) > 3}
    level = lambda x: [int(v[1]) for v in x or [] if v[0] == "L"]
    want = []
    for i, t, lv in rows:
        if i is None or i % 4:
            continue
        mine = long(t) | {"noise", "rare1"}
        scored = []
        for j, u, lw in rows:
            if j is not None and j != i:
                near = max((1.0 - 0.15 * abs(x - y) for x in level(lv) for y in level(lw)), default=0.0)
                scored.append((-(0.5 * (len(mine & long(u)) / max(1, len(mine | long(u)))) + 0.5 * near), j))
        want += [(i, j, round(-s, 9), r + 1) for r, (s, j) in enumerate(sorted(scored)[:15])]
    got = seeds.retrieve(new, papers, common=common).select("new_id", "paper_id", F.round("relevance", 9), "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_retrieval_of_nothing(spark):
    papers = spark.createDataFrame([], "paper_id long, title string, knowledge_level array<string>")
    assert seeds.retrieve(papers, papers).count() == 0


def test_retrieval_has_no_product(spark, sf_dir):
    plan = queries.QUERIES["retrieval_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Cross" not in plan
