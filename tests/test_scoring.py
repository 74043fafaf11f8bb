"""Scores against plain restatements of their rules, on edge rows too."""

import math
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import scoring, screening

PAPER = "paper_id string, title string, abstract string, year int, citations int, venue string, pos bigint"
QUERY = "FxLMS-based active vibration control of H2 plates with the the NN"


@pytest.fixture(scope="module")
def papers(spark):
    rows = [
        ("p0", "Active vibration control", "FxLMS control of a plate", 2026, 120, "Nature", 0), ("p1", "", "", None, None, None, 1), ("p2", None, None, 0, 0, "", 2), ("p3", "Wildfire spread", "the the satellite image network", 2025, 50, "IEEE Transactions on X", 3),
        ("p4", "Template of speech", "control and noise damping", 2024, 10, "Some venue", 4), ("p5", "H2 H2 nn", "active", 2030, 1, "ICML", 5), ("p6", "ÉTUDE du contrôle", "vibration", 2023, 9, None, 6), ("p7", "Survey", "feedback filter", 2010, 99, None, 7),
    ]
    return spark.createDataFrame(rows, PAPER)


def tokens(t):
    return [x.lower() for x in re.findall("[a-zA-Z0-9]+", t or "")]


def bm25(rows, query):
    docs = {r.paper_id: tokens(r.title) + tokens(r.abstract) for r in rows}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for k, d in docs.items():
        s = 0.0
        for q in tokens(query):
            df = sum(q in x for x in docs.values())
            f = d.count(q)
            if f:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.5 + 0.5 * len(d) / avg))
        out[k] = s
    return out


def test_query_words():
    intent, background = scoring.query_words("FxLMS-based H-infinity H2 3D robust control of ANC CamelCase via co-op new")
    assert {"fxlms-based", "infinity", "h2", "3d", "robust", "control", "anc", "camelcase"} == set(intent)
    assert set(background) == {"of", "via", "new"}
    assert scoring.query_words("the of") == ([], ["of", "the"])


def test_bm25(papers):
    want = bm25(papers.collect(), QUERY)
    for r in scoring.bm25(papers, QUERY).collect():
        assert math.isclose(r.bm25, want[r.paper_id], rel_tol=1e-12, abs_tol=1e-12)
    assert {r.bm25 for r in scoring.bm25(papers, "---").collect()} == {0.0}
    assert scoring.bm25(papers.limit(0), QUERY).count() == 0


def test_bm25_shuffles_no_rows(papers):
    plan = scoring.bm25(papers, QUERY)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("Exchange SinglePartition") == 1


def test_dry_score(papers):
    intent, background = scoring.query_words(QUERY)
    require, exclude = scoring.domain_of(QUERY)
    want = bm25(papers.collect(), QUERY)
    for r in scoring.dry_score(papers, QUERY, now=2026, require=require, exclude=exclude).collect():
        t, a = tokens(r.title), tokens(r.abstract)
        it, ia = sum(w in t for w in intent), sum(w in a for w in intent)
        i = min(1, (3 * it + 1.5 * ia) / (3 * len(intent)))
        bg = 0.2 * min(1, sum(w in t + a for w in background) / max(len(background), 1))
        age = 2026 - r.year if r.year else 0
        re_ = 0.15 * (1 if age <= 0 else 0.7 if age == 1 else 0.4 if age == 2 else 0)
        c = r.citations or 0
        im = 0.1 * (1 if c >= 100 else 0.7 if c >= 50 else 0.4 if c >= 10 else 0.2 if c > 0 else 0)
        low = [(r.title or "").lower(), (r.abstract or "").lower()]
        has = lambda w: any(w in x for x in low)
        f = 1.0
        if not any(map(has, require)):
            f = 0.7 if sum(map(has, scoring.NEIGHBOURS)) >= 2 else 0.3
        bad = sum(map(has, exclude))
        f *= max(0.1, 1 - 0.15 * bad) if bad else 1
        raw = (min(want[r.paper_id] / 10, 1) * 0.3 + i * 0.4 + bg * 0.1 + re_ * 0.1 + im * 0.1) * f
        assert math.isclose(r.dry_raw, raw, abs_tol=1e-12) and r.passed == (raw >= 0.25) and 0 <= r.dry_score <= 0.7451
        assert ("intent_in_title" in r.reason) == (it > 0) and ("below_threshold" in r.reason) == (not r.passed)


def test_substring_penalty_hits_template(spark):
    rows = spark.createDataFrame([("a", "A template", "x", 2026, 0, "", 0)], PAPER)
    r = scoring.dry_score(rows, "plate", now=2026, require=["plate"]).first()
    assert "no_domain_word" not in r.reason


def test_composite(papers, spark):
    intent, background = ("vibration", "control"), ("the",)
    context = scoring.Context(QUERY, intent, background, 2026)
    meta = spark.createDataFrame([("p4", 500, "NeurIPS proceedings", 5), ("p4", 500, "NeurIPS proceedings", 5)], "paper_id string, cited_by_count int, venue_name string, author_count int")
    later = spark.createDataFrame([("p4", "Cell")], "paper_id string, venue_name string")

    def broken(_):
        raise ValueError("no such thing")

    c = scoring.Composite(context).add_source(meta).add_source(later)
    for name in ("intent", "background", "recency", "impact", "venue", "author"):
        c.add_scorer(name, scoring.WEIGHTS[name])
    c.add_scorer("broken", 0.25, broken)
    rows = {r.paper_id: r for r in c.score(papers).collect()}
    assert len(rows) == 8
    s = {x.name: x for x in rows["p4"].scores}
    assert s["venue"].value == 1.0 and s["impact"].value == 1.0 and s["author"].value == 1.0 and s["broken"].value == 0.0 and s["recency"].value == pytest.approx(0.6)
    total = sum(x.weight for x in rows["p4"].scores)
    assert rows["p4"].composite == pytest.approx(sum(x.weighted for x in rows["p4"].scores) / total) and total == pytest.approx(1.10)
    assert {x.name: x.value for x in rows["p2"].scores}["recency"] == 0.5 and {x.name: x.value for x in rows["p5"].scores}["recency"] == 0.5
    assert {x.name: x.value for x in rows["p5"].scores}["venue"] == 0.6

    @scoring.scorer("short")
    def _short(_):
        return (F.length("title") < 10).cast("double")

    assert scoring.Composite(context).add_scorer("short", 1.0).score(papers).where("composite = 1").count() == 3


def test_keyword_filter_relaxes(papers):
    strict = screening.keyword_filter(papers, relax_below=1)
    assert {r.paper_id for r in strict.collect()} == {"p0", "p4", "p7"}
    assert {r.paper_id for r in screening.keyword_filter(papers, relax_below=5).collect()} == {"p0", "p4", "p5", "p6", "p7"}
    assert {r.paper_id for r in screening.keyword_filter(papers, always=["PLATE"], relax_below=1).collect()} == {"p7"}  # and the template
    twice = papers.union(papers.withColumn("pos", F.col("pos") + 100))
    assert screening.keyword_filter(twice, relax_below=1).count() == 3
    assert screening.keyword_filter(papers.limit(0)).count() == 0


def test_fallback_tiers(papers, spark):
    scored = papers.withColumn("relevance", F.lit(2))
    assert [r.paper_id for r in screening.keep_relevant(scored, 2).collect()] == ["p0", "p7"]
    assert [r.paper_id for r in screening.keep_relevant(scored.withColumn("relevance", F.when(F.col("pos") == 2, 4).otherwise(1)), 2).collect()] == ["p2"]
    none = papers.where("pos < 0")
    assert [r.paper_id for r in screening.passing_first(papers, none, 3).collect()] == ["p0", "p1", "p2"]
    assert [r.paper_id for r in screening.passing_first(papers, papers.where("pos > 4"), 2).collect()] == ["p5", "p6"]
    base = papers.withColumns({"dry_score": F.col("pos") / 10, "passed": F.lit(False), "mean_score": F.lit(None).cast("double"), "llm_passed": F.lit(None).cast("boolean")})
    assert {r.paper_id for r in screening.core_papers(base, n=2).collect()} == {"p7", "p6"}
    assert {r.paper_id for r in screening.core_papers(base.withColumn("passed", F.col("pos") == 1)).collect()} == {"p1"}
    some = base.withColumn("mean_score", F.when(F.col("pos") < 3, F.col("pos") + 1.5))
    assert {r.paper_id for r in screening.core_papers(some).collect()} == {"p2"}
    assert {r.paper_id for r in screening.core_papers(some, mean_gate=9).collect()} == {"p0", "p1", "p2"}


def test_ladder_of_costly_sources(papers):
    asked = []

    def source(name, rows):
        def ask():
            asked.append(name)
            return rows

        return name, ask

    name, found = screening.run_ladder([source("a", papers.limit(0)), source("b", papers.limit(2)), source("c", papers)])
    assert name == "b" and found.count() == 2 and asked == ["a", "b"]
