"""Graph tables and ontology changes on small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspark.model import EDGE, Policy
from quillspark.operators import graph, ontology, reports, seeds

NODES = "id string, type string, title string, knowledge_level array<string>, seq bigint"


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("a", "seed", "alpha beta", ["L1-x"], 1), ("b", "seed", "beta alpha", ["L1-x"], 1), ("c", "paper", "gamma", ["L2-y"], 1), ("d", "paper", "delta", ["L3-z"], 1)], NODES)
    edges = [("c", "b", 0.5), ("d", "b", 0.4), ("d", "a", 0.9), ("a", "b", 0.2)]
    rows = spark.createDataFrame(edges, "s string, t string, v double")
    return nodes, rows.select(*graph.correlation(F.col("s"), F.col("t"), F.col("v"))).withColumn("seq", F.lit(1))


def test_upsert_keeps_edges(spark, small):
    nodes, edges = small
    new = spark.createDataFrame([("a", "seed", "renamed", ["L1-x"], 5), ("a", "seed", "older", ["L1-x"], 3), ("e", "seed", "new", [], 1)], NODES)
    after = {r.id: r.title for r in graph.upsert(nodes, new).collect()}
    assert after == {"a": "renamed", "b": "beta alpha", "c": "gamma", "d": "delta", "e": "new"}
    assert graph.attached(edges, graph.upsert(nodes, new)).count() == 4 and graph.attached(edges, nodes.where("id <> 'b'")).count() == 1


def test_promotion_and_downgrade(spark, small):
    _, edges = small
    at = F.lit("2026-01-02 03:04:05")
    asked = spark.createDataFrame([("edge::c::b", ["temporal_precedence", "nonsense"], None), ("edge::d::b", ["nonsense"], 0.9), ("edge::none::none", ["mechanistic_chain"], 0.1)], "id string, conditions array<string>, confidence double")
    first = {r.id: r for r in graph.promote(edges, asked, at).collect()}
    assert first["edge::c::b"].base_type == "causation" and first["edge::c::b"].causal_promotion.confidence == 0.25 and len(first["edge::c::b"].history) == 1
    assert first["edge::d::b"].error == "no valid condition" and first["edge::d::b"].base_type == "correlation" and len(first) == 4
    done = graph.promote(edges, asked, at).drop("error")
    assert {r.id: r.error for r in graph.promote(done, asked, at).collect()}["edge::c::b"] == "already causal"
    back = spark.createDataFrame([("edge::c::b", "no longer"), ("edge::d::a", "never was")], "id string, reason string")
    down = {r.id: r for r in graph.downgrade(done, back, at).collect()}
    assert down["edge::c::b"].base_type == "correlation" and [h.action for h in down["edge::c::b"].history] == ["promoted", "downgraded"]
    assert down["edge::d::a"].error == "not causal"
    checked = {r.id: r.promotion for r in graph.promotion_check(done.withColumn("mechanism_description", F.when(F.col("id") == "edge::d::a", "x" * 21).otherwise("x" * 20))).collect()}
    assert checked["edge::c::b"].status == "already_causal" and checked["edge::d::a"].met == ["mechanistic_chain"] and checked["edge::d::b"].met == []


def test_pairs_count_and_score(spark):
    rows = spark.createDataFrame([(f"p{i}", i / 1000, i) for i in range(900)], "paper_id string, dry_score double, pos bigint")
    out = graph.pairs(rows).collect()
    k = sum(i / 1000 > 0.2 for i in range(900))
    assert len(out) == k * (k - 1) // 2
    value = {f"p{i}": i / 1000 for i in range(900)}
    assert all(r.base_score == value[r.target_id] <= value[r.source_id] for r in out)
    assert graph.pairs(rows, most=10).count() == 45 and graph.pairs(rows.limit(0)).count() == 0


def test_merge_split_reparent(spark, small):
    nodes, edges = small
    n, e = ontology.merge(nodes, edges, spark.createDataFrame([("a", "b")], "a string, b string"))
    ends = {(r.source_id, r.target_id): r.base_score for r in e.collect()}
    assert ends == {("c", "b"): 0.5, ("d", "b"): 0.4, ("d", "a"): 0.9, ("a", "b"): 0.2, ("c", "a"): 0.5}
    assert {r.id: r.title for r in n.collect()}["a"] == "alpha beta + beta alpha" and n.count() == 4
    n, e = ontology.split(nodes, edges, spark.createDataFrame([("a", ["one", "two"])], "id string, children array<string>"))
    assert {r.title for r in n.collect()} >= {"one", "two", "alpha beta (split)"} and e.where("base_score = 0.9").count() == 3
    e, log = ontology.reparent(nodes, edges, spark.createDataFrame([("c", "alpha beta"), ("c", "nothing")], "node string, parent string"))
    assert e.where("source_id = 'c' AND target_id = 'a' AND base_score = 1").count() == 1 and "beside b" in log.first().description
    n, e, _ = ontology.insert_level(nodes, edges, "L5-new", "alpha beta")
    assert n.count() == 5 and e.where("target_id = 'a' AND base_score = 0.8").count() == 1


def test_guarded_apply(spark, small):
    nodes, edges = small
    good = {c: {"value": True} for c in ontology.TRUTHS[:2]}
    report = lambda action, changes, conds=good: {"conflict_assessment": {"recommended_action": action, "conceptual_change_conditions": conds}, "changes": changes}
    merge = [{"type": "merge", "node_a": "a", "node_b": "b"}]
    assert ontology.apply(nodes, edges, report("single_loop", merge))[2][0]["change_type"] == "skipped"
    assert ontology.apply(nodes, edges, report("double_loop", merge), consecutive=2)[2][0]["reason"] == "consecutive_trigger_limit"
    assert ontology.apply(nodes, edges, report("double_loop", merge, {"plausibility": {"value": "yes"}}))[2][0]["reason"] == "insufficient_conditions"
    assert ontology.apply(nodes, edges, report("double_loop", merge))[2][0]["reason"] == "impact_ratio_exceeded"
    n, e, log = ontology.apply(nodes, edges, report("seed_anchored", [*merge, {"type": "split"}, {"type": "odd"}]))
    assert [x["change_type"] for x in log] == ["merge", "error", "error", "ontology_change_applied"] and e.count() == 5
    assert ontology.apply(nodes, edges, report("double_loop", merge), policy=Policy(max_impact_ratio=0.6))[2][0]["change_type"] == "merge"


def test_decision_tree(spark):
    def rule(n, run, score, conds, impact):
        if n < 10:
            return "seed_anchored"
        if run >= 2:
            return "degraded_by_meta"
        if (score or 0) < 0.5 or conds < 2:
            return "single_loop"
        return "degraded_by_meta" if impact > 0.3 else "double_loop"

    cases = [(*c, rule(*c)) for c in itertools.product([9, 10], [1, 2], [0.49, 0.5, None], [1, 2], [0.3, 0.31])]
    rows = spark.createDataFrame(cases, "n int, run int, score double, conds int, impact double, want string")
    c = F.col
    assert rows.where(ontology.decide(c("n"), c("run"), c("score"), c("conds"), c("impact")) != c("want")).count() == 0 and rows.count() == 48


def test_sibling_pairs_match_all_pairs(spark):
    draw = random.Random(1)
    rows = [(f"n{i}", " ".join(draw.sample(["aa", "bb", "cc", "dd", "ee", "ff"], draw.randrange(1, 6))), [draw.choice(["L1", " L1 ", "L2"])]) for i in range(80)]
    nodes = spark.createDataFrame(rows, "id string, title string, knowledge_level array<string>")
    got = {(r.level, r.a, r.b) for r in ontology.sibling_pairs(nodes, 0.7).collect()}
    sets = [(i, set(t.split()), k[0].strip()) for i, t, k in rows]
    want = {(k, *sorted((i, j))) for (i, s, k), (j, t, m) in itertools.combinations(sets, 2) if k == m and len(s & t) / len(s | t) >= 0.7}
    assert got == want
    merges = ontology.disjoint_merges(ontology.sibling_pairs(nodes, 0.7)).collect()
    seen, greedy = set(), set()
    for level, a, b in sorted(want):
        if not {a, b} & seen:
            seen |= {a, b}
            greedy.add((level, a, b))
    assert {(r.level, r.a, r.b) for r in merges} == greedy


def test_sibling_merges_are_the_pairs_in_order(spark):
    draw = random.Random(4)
    rows = [(f"n{i}", " ".join(draw.sample(["aa", "bb", "cc", "dd", "ee"], draw.randrange(1, 5))), draw.sample(["L1", " L1", "L2", "L3"], draw.randrange(1, 4))) for i in range(120)]
    rows += [rows[0], rows[7], ("empty", "", ["L1"]), ("nolevel", "aa bb", None), ("nowhere", "aa bb", []), (None, "aa bb", ["L1"]), ("untitled", None, ["L1"])]
    rows += [(f"same{i}", "xx yy", ["L4"]) for i in range(31)]
    nodes = spark.createDataFrame(rows, "id string, title string, knowledge_level array<string>")
    sets = sorted({(k.strip(), i, frozenset(t.split())) for i, t, ks in rows if i and t for k in ks or ()}, key=lambda r: r[:2])
    seen, want = set(), []
    for (k, i, v), (m, j, w) in itertools.combinations(sets, 2):  # in order of level, a, b
        if k == m and len(v & w) / len(v | w) >= 0.5 and not {i, j} & seen:
            seen |= {i, j}
            want.append((k, i, j, round(len(v & w) / len(v | w), 3)))
    got = ontology.sibling_merges(nodes, 0.5).orderBy("level", "a").collect()
    assert [tuple(r) for r in got] == want and sum(k == "L4" for k, *_ in want) == 15
    assert ontology.sibling_merges(nodes.limit(0), 0.5).count() == 0


def test_distil(spark, small):
    nodes, edges = small
    _, e, merges, thin = ontology.distil(nodes, edges, dry_run=False)
    assert [(r.a, r.b) for r in merges.collect()] == [("a", "b")] and {r.level for r in thin.collect()} == set()
    assert e.count() == 5


def test_consecutive_triggers(spark):
    log = spark.createDataFrame([(1, "double_loop"), (2, "other"), (3, "double_loop"), (4, "ontology_change_applied")], "id bigint, action string")
    assert ontology.consecutive_triggers(log).first().consecutive == 2
    assert ontology.consecutive_triggers(log.limit(0)).first().consecutive == 0


def test_graph_build_and_index(spark):
    papers = spark.createDataFrame([("p1", "One", 2020), ("p2", "Two", None), ("p3", "Three", 2021)], "paper_id string, title string, year int")
    dry = spark.createDataFrame([("p1", 0.5, 0), ("p2", 0.3, 1), ("p3", 0.0, 2)], "paper_id string, dry_score double, pos bigint")
    said = spark.createDataFrame([("p2", 4.0)], "paper_id string, mean_score double")
    seeds_ = spark.createDataFrame([("method-1", "one", 3, "method", "", ["uno"], ["one"], 1)], "node_id string, name string, level int, category string, description string, aliases array<string>, keywords array<string>, seed_pos int")
    found = seeds.match_rows(papers.withColumn("abstract", F.lit("about uno")), seeds_)
    nodes, edges = graph.build(papers, dry, said, found, seeds_)
    assert {r.id for r in nodes.collect()} == {"p1", "p2", "p3", "b1-p1", "b1-p2", "b2-p2", "method-1"}
    assert {(r.source_id, r.target_id) for r in edges.collect()} >= {("p1", "b1-p1"), ("p2", "b2-p2"), ("p1", "p2")}
    index = graph.score_index(nodes, edges).orderBy("rank").collect()
    assert [r.paper_id for r in index] == ["p2", "p1", "p3"] and index[0].b2 == 0.8
    assert graph.seeded(nodes.limit(0), seeds_).count() == 1 and graph.seeded(nodes, seeds_).count() == 7
    from quillspark.operators import render

    notes = {r.name: r.text for r in render.vault(nodes, edges, dry.withColumn("passed", F.lit(True))).collect()}
    assert "papers/p1.md" in notes and "graph LR" in notes["00-meta/causal-map.md"] and "| 1 | [[p2]]" in notes["papers/index.md"]
    assert "method-1" in notes["00-meta/near-transfer.md"] and "- Total: 3" in notes["00-meta/scores.md"]
    assert {r.part for r in render.graph_json(nodes, edges).collect()} == {"node", "edge", "stats"}


def test_seed_levels_and_schema(spark):
    assert spark.createDataFrame([], EDGE).columns[:3] == ["id", "source_id", "target_id"]
    nodes = spark.createDataFrame([("a", "seed", ["L1-axiom"]), ("b", "seed", ["L5-x"]), ("c", "paper", ["L1-axiom"])], "id string, type string, knowledge_level array<string>")
    assert [r.id for r in seeds.of_levels(nodes).collect()] == ["a"]


def test_reports(spark):
    rows = spark.createDataFrame([("p1", 0.9, True, 0, 4.0), ("p2", 0.25, True, 1, None), ("p3", 0.1, False, 2, 0.0)], "paper_id string, dry_score double, passed boolean, pos bigint, mean_score double")
    assert {r.bin: r.n for r in reports.histogram(rows).collect()} == {"0.0-0.2": 1, "0.2-0.3": 1, "0.3-0.4": 0, "0.4-0.5": 0, "0.5-0.6": 0, "0.6-0.7": 0, "0.7-1.0": 1}
    assert [r.paper_id for r in reports.best_first(rows).collect()] == ["p1", "p2", "p3"]
    assert reports.score_means(rows).first().mean_review == 4.0
