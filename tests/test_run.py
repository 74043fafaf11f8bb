"""A whole run in phases, taken up again, in dry and full mode."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import adapters
from quillspark.plans import pipeline
from quillspark.plans.state import Config, Run

SEEDS = "node_id string, name string, level int, category string, description string, aliases array<string>, keywords array<string>, seed_pos int"
PAPERS = "paper_id string, title string, abstract string, year int, citations int, source string, venue string, doi string, arxiv_id string, pos bigint"


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([("method-1", "adaptive control", 3, "method", "", ["vibration"], ["adaptive", "control"], 1), ("phys-1", "plates", 4, "physics", "", [], ["plate"], 2)], SEEDS)


@pytest.fixture(scope="module")
def papers(spark):
    rows = [(f"p{i}", f"Adaptive vibration control {i}", "active noise control of plates with FxLMS filters" if i % 2 else "other things", 2015 + i, i * 10, "s", "", "", "", i) for i in range(12)]
    return spark.createDataFrame(rows, PAPERS)


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"query": "${WHAT} now", "top": 3}')
    c = Config.load(str(tmp_path / "c.json"), {"WHAT": "plates", "QUILLSPARK_TOP": "5", "QUILLSPARK_TITLE_ONLY": "true", "QUILLSPARK_YEAR_MAX": "2024"}, mode="lite")
    assert (c.query, c.top, c.title_only, c.year_max, c.mode) == ("plates now", 5, True, 2024, "lite")
    (tmp_path / "bad.json").write_text('{"nonsense": 1}')
    with pytest.raises(ValueError, match="nonsense"):
        Config.load(str(tmp_path / "bad.json"), {})


def test_dry_run_and_resume(spark, papers, seeds, tmp_path):
    asked = []

    def find(q):
        asked.append(q)
        return papers

    config = Config(query="FxLMS adaptive vibration control", papers=6)
    out = pipeline.run(spark, str(tmp_path / "run"), config, find, seeds)
    assert out["total"] == 6 and out["papers"] == 6 and out["status"]["G"] == "done" and out["status"]["B2"] == "pending"
    again = pipeline.run(spark, str(tmp_path / "run"), config, find, seeds)
    assert again == out and len(asked) == 1
    state = Run(spark, str(tmp_path / "run"))
    assert min(r.year for r in state.table("A").collect()) >= 2018
    assert {r.name for r in state.table("G").collect()} >= {"papers/index.md", "00-meta/scores.md"}
    assert "# Review" in (tmp_path / "run" / "review.md").read_text()
    assert state.table("nodes").where("type = 'paper' AND size(knowledge_level) > 0").count() > 0


def test_full_run(spark, papers, seeds, tmp_path):
    reply = json.dumps({"C1": 4, "C2": 4, "knowledge_level": ["L3-x"], "knowledge_level_confidence": 0.4, "structure_template": {"control_architecture": "ff"}, "conflict_assessment": {"unexplainability_score": 0.7, "conceptual_change_conditions": {"plausibility": {"value": True}, "fruitfulness": {"value": True}}}, "changes": [{"type": "reparent"}]})
    config = Config(query="adaptive vibration control", mode="full", papers=12, top=2, searches=1)
    out = pipeline.run(spark, str(tmp_path / "run"), config, lambda q: papers, seeds, adapter=adapters.Replay({}, reply))
    state = Run(spark, str(tmp_path / "run"))
    assert set(out["status"].values()) == {"done", "pending"} and out["status"]["F2"] == "done"
    assert state.table("B2").count() == 2 and state.table("core").count() == 2
    assert {r.action for r in state.table("decisions").collect()} <= {"double_loop", "degraded_by_meta", "seed_anchored"}
    assert state.table("edges").where(F.startswith("target_id", F.lit("b2-"))).count() == 2


def test_unknown_mode(spark, papers, seeds, tmp_path):
    with pytest.raises(ValueError, match="mode"):
        pipeline.run(spark, str(tmp_path), Config(mode="odd"), lambda q: papers, seeds)
