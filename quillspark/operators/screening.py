"""Filters that narrow a set of papers, and ways out where too few are left.

Decisions that depend on how many rows are left are made by one-row aggregates
joined back as a broadcast row, not by driver loops, so a plan stays one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hits, text_or_empty

#: Word lists of the keyword filter (fixed values).
CORE = ("adaptive", "feedforward", "feedback", "control", "FxLMS", "LMS", "vibration", "noise", "suppression", "isolation", "active", "filter", "neural")
EXCLUDE_ALWAYS = ("Routhian", "symplectic", "Hamiltonian", "pedagogy", "student")
EXCLUDE_ALONE = ("education", "survey", "review", "tutorial")
#: Columns that no operator reads (fixed values).
REDUNDANT = (
    "referenced_works", "locations", "abstract_inverted_index", "authorships", "concepts", "mesh", "topics", "related_works", "counts_by_year", "grants", "ids",
    "host_venue", "alternate_host_venues", "corresponding_author_ids", "corresponding_institution_ids",
)


def years(papers: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Papers of a range of years; a missing year is 0."""
    year = F.coalesce(F.col("year"), F.lit(0))
    keep = F.lit(True)
    if first is not None:
        keep = keep & (year >= first)
    if last is not None:
        keep = keep & (year <= last)
    return papers.where(keep)


def filled(papers: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is blank."""
    for c in columns:
        papers = papers.where(F.length(F.trim(text_or_empty(F.col(c)))) > 0)
    return papers


def slim(papers: DataFrame, columns: Sequence[str] = REDUNDANT) -> DataFrame:
    return papers.drop(*columns)


def first_rows(papers: DataFrame, *keys: str, pos: str = "pos") -> DataFrame:
    """The first row of each key, by an aggregate: the rows of a key are never sorted in one task.  Keys are compared null-safe."""
    return papers.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min_by(F.struct(*papers.columns), pos).alias("_r")).select("_r.*")


def first_tier(tiers: DataFrame, tier: str = "tier") -> DataFrame:
    """Rows of the lowest tier that has any; the choice is one aggregate, joined as one row."""
    return tiers.join(F.broadcast(tiers.agg(F.min(tier).alias("_best"))), F.col(tier) == F.col("_best")).drop("_best")


def keyword_filter(papers: DataFrame, *, core: Sequence[str] = CORE, always: Sequence[str] = EXCLUDE_ALWAYS, alone: Sequence[str] = EXCLUDE_ALONE, least: int = 2, relax_below: int = 5, key: str = "paper_id", pos: str = "pos") -> DataFrame:
    """Papers with enough core words, first row of each key.

    A paper with a word of ``always`` goes; one whose title has a word of ``alone`` needs
    two core words; others need ``least``, or one where fewer than ``relax_below``
    papers would be left.
    """
    title, whole = F.lower(text_or_empty(F.col("title"))), F.lower(F.concat_ws(" ", text_or_empty(F.col("title")), text_or_empty(F.col("abstract"))))
    low = lambda words: [w.lower() for w in words]
    n = hits(whole, low(core))
    rows = papers.withColumn("core_hits", n).where((hits(whole, low(always)) == 0) & ~((hits(title, low(alone)) > 0) & (n < 2)) & (n >= 1))
    strict = F.countDistinct(F.when(F.col("core_hits") >= least, F.col(key)))
    enough = rows.agg((strict >= relax_below).alias("_strict"))
    kept = rows.join(F.broadcast(enough)).where((F.col("core_hits") >= least) | ~F.col("_strict")).drop("_strict")
    return first_rows(kept, key, pos=pos)


def ladder(papers: DataFrame, strategies: Sequence[tuple[str, Column]], keep: Column) -> DataFrame:
    """Rows of the first strategy that has a row which ``keep`` lets through: (papers..., strategy)."""
    rows = None
    for i, (name, condition) in enumerate(strategies):
        tried = papers.where(condition).withColumns({"strategy_no": F.lit(i), "strategy": F.lit(name)})
        rows = tried if rows is None else rows.unionByName(tried)
    return first_tier(rows.where(keep), "strategy_no").drop("strategy_no")


def run_ladder(attempts: Sequence[tuple[str, Callable[[], DataFrame]]]) -> tuple[str, DataFrame]:
    """The same over sources that cost something to ask: each is asked only if those before gave nothing."""
    for name, attempt in attempts[:-1]:
        found = attempt()
        if not found.isEmpty():
            return name, found
    name, attempt = attempts[-1]
    return name, attempt()


def top(papers: DataFrame, n: int, *by: str, pos: str = "pos") -> DataFrame:
    """The first n rows by the columns, descending, then by place."""
    return papers.orderBy(*[F.desc(c) for c in by], pos).limit(n)


def keep_relevant(scored: DataFrame, n: int, *, least: int = 3, score: str = "relevance", pos: str = "pos") -> DataFrame:
    """The n most relevant of score ``least`` or more; if there are none, the n most cited and newest."""
    good = scored.where(F.col(score) >= least).withColumn("tier", F.lit(0)).withColumn("_a", F.col(score).cast("double")).withColumn("_b", F.lit(0.0))
    rest = scored.withColumn("tier", F.lit(1)).withColumn("_a", F.coalesce(F.col("citations"), F.lit(0)).cast("double")).withColumn("_b", F.coalesce(F.col("year"), F.lit(0)).cast("double"))
    return first_tier(good.unionByName(rest)).orderBy(F.desc("_a"), F.desc("_b"), pos).limit(n).drop("tier", "_a", "_b")


def passing_first(papers: DataFrame, passing: DataFrame, n: int, *, key: str = "paper_id", pos: str = "pos") -> DataFrame:
    """The first n papers, in order of input, that passed; if none did, the first n."""
    marked = papers.join(passing.select(key).distinct().withColumn("_in", F.lit(0)), key, "left").withColumn("tier", F.coalesce("_in", F.lit(1))).drop("_in")
    return first_tier(marked).drop("tier").orderBy(pos).limit(n)


def core_papers(scored: DataFrame, *, mean_gate: float = 3.0, n: int = 10, pos: str = "pos") -> DataFrame:
    """The papers that later phases work on: rows with (dry_score, passed, mean_score, llm_passed), by the first tier that has any.

    Reviewed with a mean of at least ``mean_gate`` or passed; else all reviewed; else those past the dry gate; else
    the n best by dry score.
    """
    reviewed = F.col("mean_score").isNotNull()
    tier = F.when(reviewed & ((F.col("mean_score") >= mean_gate) | F.coalesce(F.col("llm_passed"), F.lit(False))), 0).when(reviewed, 1).when(F.coalesce(F.col("passed"), F.lit(False)), 2).otherwise(3)
    rows = scored.withColumn("tier", tier)
    best = F.broadcast(rows.agg(F.min("tier").alias("_best")))
    # only the last tier is cut, and its n best are a top-k over all tasks
    last = rows.where("tier = 3").orderBy(F.desc("dry_score"), pos).limit(n)
    return rows.where("tier < 3").unionByName(last).join(best, F.col("tier") == F.col("_best")).drop("_best")


def unread(papers: DataFrame, done: DataFrame, key: str = "paper_id") -> DataFrame:
    """Papers that have no result yet, for a run that is taken up again."""
    return papers.join(done.select(key), key, "left_anti")
