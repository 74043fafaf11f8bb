"""A run over papers in phases: search, scores, reviews, further searches, synthesis, structure, conflicts, graph.

Each phase is a function of DataFrames, written where a later phase reads it more
than once; that also makes it the point from which a run goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adapters, graph, ontology, render, reports, scoring, screening, seeds
from .state import MODES, Config, Run

Search = Callable[[str], DataFrame]


def search(config: Config, find: Search) -> DataFrame:
    """Phase A: papers of the years asked for, past the keyword filter, the most cited first; all of those years if none pass it."""
    found = screening.years(find(config.query), config.year_min, config.year_max)
    kept = screening.keyword_filter(found).select("paper_id", F.lit(0).alias("tier"))
    rows = found.join(kept.withColumnRenamed("tier", "_t"), "paper_id", "left").withColumn("tier", F.coalesce("_t", F.lit(1))).drop("_t")
    return screening.top(screening.first_tier(rows).drop("tier"), config.papers, "citations", "year")


def score(config: Config, papers: DataFrame) -> DataFrame:
    """Phase B1: the dry score, with the field that the query asks for."""
    require, exclude = scoring.domain_of(config.query) or ((), ())
    return scoring.dry_score(papers, config.query, now=config.now, require=require, exclude=exclude)


def review(config: Config, scored: DataFrame, adapter: adapters.Adapter, system: str, template: str) -> DataFrame:
    """Phase B2: reviews of the first papers that passed."""
    return adapters.reviewed(screening.passing_first(scored, scored.where("passed"), config.top), adapter, system=system, template=template, gate=config.review_gate)


def further(config: Config, core: DataFrame, find: Search, phase: str) -> DataFrame:
    """Phases C and D: papers of the phase's queries, each paper once, with the query that found it."""
    asked = [r["query"] for r in adapters.further_queries(core, config.searches).where(F.col("phase") == phase).orderBy("pos").collect()]
    found = None
    for i, q in enumerate(asked):
        rows = find(q).withColumns({"found_by": F.lit(q), "pos": F.col("pos") + F.lit(i << 40)})
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if found is None:
        return core.limit(0).withColumn("found_by", F.lit(""))
    return screening.first_rows(found, "paper_id")


def structure(config: Config, core: DataFrame, seed_table: DataFrame, adapter: adapters.Adapter | None, system: str = "", template: str = "{title}") -> DataFrame:
    """Phase F: seeds of each paper; where a model gives levels of its own, they stand first."""
    found = seeds.match_rows(core, seed_table, title_only=config.title_only)
    if adapter is None:
        return found
    said = adapters.structures(core, adapter, system=system, template=template).select("paper_id", F.col("knowledge_level").alias("_l"), F.col("knowledge_level_confidence").alias("_c"), "structure_template")
    own = F.size(F.coalesce("_l", F.array().cast("array<string>"))) > 0
    rows = found.join(said, "paper_id", "left")
    return rows.withColumns({"knowledge_level": F.when(own, F.col("_l")).otherwise(F.col("knowledge_level")), "knowledge_level_confidence": F.when(own, F.col("_c")).otherwise(F.col("knowledge_level_confidence"))}).drop("_l", "_c")


def uncertain(structured: DataFrame) -> DataFrame:
    """Papers for phase F2: little confidence, or a template without content."""
    empty = F.lit(True)
    if "structure_template" in structured.columns:
        t = F.col("structure_template")
        empty = t.isNull() | (F.coalesce(F.concat_ws("", t["control_architecture"], t["abstract_pattern"], t["mathematical_core"], t["optimization_target"], t["domain_abstraction"]), F.lit("")) == "")
    return structured.where((F.col("knowledge_level_confidence") < 0.6) | empty)


def run(spark: SparkSession, path: str, config: Config, find: Search, seed_table: DataFrame, *, adapter: adapters.Adapter | None = None, prompts: dict[str, tuple[str, str]] | None = None, consecutive: int = 0) -> dict[str, object]:
    """All phases of the mode; returns counts and the folder.  ``prompts`` has (system, template) by phase."""
    if config.mode not in MODES:
        raise ValueError(f"a mode is one of {', '.join(MODES)}")
    phases, state = MODES[config.mode], Run(spark, path)
    model = None if config.mode == "dry" else adapter
    said = lambda p: (prompts or {}).get(p, ("", "{title}\n{abstract}"))
    papers = state.phase("A", lambda: search(config, find))
    scored = state.phase("B1", lambda: score(config, papers))
    reviewed = state.phase("B2", lambda: review(config, scored, model, *said("B2"))) if "B2" in phases and model else None
    if reviewed is not None:
        full = scored.join(reviewed.select("paper_id", "mean_score", "llm_passed"), "paper_id", "left")
    else:
        full = scored.withColumns({"mean_score": F.lit(None).cast("double"), "llm_passed": F.lit(None).cast("boolean")})
    core = state.phase("core", lambda: screening.core_papers(full, mean_gate=config.review_gate))
    for p in ("C", "D"):
        if p in phases:
            state.phase(p, lambda p=p: further(config, core, find, p))
    state.note("review.md", adapters.review_text(core, model, system=said("E")[0], template=said("E")[1]))
    structured = state.phase("F", lambda: structure(config, core, seed_table, model, *said("F")))
    nodes, edges = graph.build(papers, scored, reviewed, structured, seed_table)
    # papers carry what phase F found for them
    levels = structured.select(F.col("paper_id").cast("string").alias("id"), F.col("knowledge_level").alias("_l"))
    nodes = nodes.join(levels, "id", "left").withColumn("knowledge_level", F.coalesce("_l", "knowledge_level")).drop("_l")
    nodes, edges = state.phase("nodes", lambda: nodes), state.phase("edges", lambda: edges)
    if "F2" in phases and model:
        system, template = said("F2")
        doubtful = core.join(uncertain(structured).select("paper_id", "knowledge_level"), "paper_id")
        known = nodes.where("type = 'paper'").select(F.col("id").alias("paper_id"), "title", "knowledge_level")
        held = lambda: adapters.conflicts(doubtful.withColumn("paper_id", F.col("paper_id").cast("string")), known, seeds.of_levels(nodes), model, system=system, template=template)
        conflicts = state.phase("F2", held)
        n = nodes.agg(F.count("*").alias("n"))
        true = F.size(F.filter(F.map_values("conditions"), lambda x: x))
        state.phase("decisions", lambda: conflicts.join(F.broadcast(n)).select("paper_id", "unexplainability", ontology.decide(F.col("n"), F.lit(consecutive), F.col("unexplainability"), true, ontology.impact(F.col("changes"), F.col("n"))).alias("action")))
    state.phase("G", lambda: render.vault(nodes, edges, scored))
    counts = graph.stats(nodes, edges).first().asDict()
    total = reports.summary(scored).first().asDict()
    return {"path": state.path, "status": state.status(), **counts, **total}
