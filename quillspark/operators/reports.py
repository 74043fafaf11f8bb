"""Aggregates for reports: distributions, rankings, transfer clusters, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import text_or_empty
from .seeds import PREFIXES

#: Edges of the histogram's bins (fixed values).
BINS = ((0.0, 0.2, "0.0-0.2"), (0.2, 0.3, "0.2-0.3"), (0.3, 0.4, "0.3-0.4"), (0.4, 0.5, "0.4-0.5"), (0.5, 0.6, "0.5-0.6"), (0.6, 0.7, "0.6-0.7"), (0.7, 9.9, "0.7-1.0"))


def histogram(scored: DataFrame, score: str = "dry_score") -> DataFrame:
    """(bin, n, percent, bar) of all seven bins, empty ones too."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    name = F.lit(BINS[-1][2])
    for _, high, label in reversed(BINS[:-1]):
        name = F.when(s < high, label).otherwise(name)
    counts = scored.groupBy(name.alias("bin")).agg(F.count("*").alias("n"))
    bins = scored.sparkSession.createDataFrame([(b,) for *_, b in BINS], "bin string")
    rows = bins.join(F.broadcast(counts), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    percent = F.col("n") / F.greatest(F.sum("n").over(W.partitionBy(F.lit(0))), F.lit(1)) * 100
    return rows.withColumn("percent", percent).withColumn("bar", F.expr("repeat('█', greatest(1, cast(percent / 2 as int)))")).withColumn("percent", F.round("percent", 1))


def summary(scored: DataFrame) -> DataFrame:
    """One row: total, passed, pass_rate, mean_score, top3_mean."""
    best = scored.orderBy(F.desc("dry_score")).limit(3).agg(F.avg("dry_score").alias("top3_mean"))
    return scored.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), (F.count_if("passed") / F.greatest(F.count("*"), F.lit(1))).alias("pass_rate"), F.coalesce(F.avg("dry_score"), F.lit(0.0)).alias("mean_score")
    ).join(F.broadcast(best))


def by_year(papers: DataFrame) -> DataFrame:
    return papers.groupBy("year").agg(F.count("*").alias("n")).orderBy(F.desc("year"))


def keyword_counts(papers: DataFrame, n: int = 8, keywords: Column | None = None) -> DataFrame:
    """The n most frequent keywords; equal counts go by the keyword."""
    words = papers.select(F.explode(keywords if keywords is not None else F.col("keywords")).alias("keyword"))
    return words.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(n)


def source_counts(papers: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """(source, n, status): sources that were asked and gave nothing are there with 0."""
    counts = papers.groupBy("source").agg(F.count("*").alias("n"))
    if expected is not None:
        asked = papers.sparkSession.createDataFrame([(s,) for s in expected], "source string")
        counts = asked.join(counts, "source", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    return counts.withColumn("status", F.when(F.col("n") > 0, "ok").otherwise("empty"))


def best_first(papers: DataFrame, n: int = 10, pos: str = "pos") -> DataFrame:
    """The n best by review score, else by dry score."""
    value = F.coalesce(F.nullif(F.col("mean_score"), F.lit(0.0)), F.col("dry_score"))
    return papers.withColumn("best", value).orderBy(F.desc("best"), pos).limit(n)


def score_means(papers: DataFrame) -> DataFrame:
    """Mean dry score, and mean review score of the papers that have one."""
    return papers.agg(F.avg("dry_score").alias("mean_dry"), F.avg(F.when(F.col("mean_score") > 0, F.col("mean_score"))).alias("mean_review"))


def passed_and_below(scored: DataFrame, below: int = 10, pos: str = "pos") -> DataFrame:
    """All that passed, and the best ``below`` of the others with their ``place``."""
    rest = scored.where(~F.col("passed")).orderBy(F.desc("dry_score"), pos).limit(below)
    rest = rest.withColumn("place", F.row_number().over(W.orderBy(F.desc("dry_score"), pos)))
    return scored.where("passed").withColumn("place", F.lit(None).cast("int")).unionByName(rest)


def near_transfer(edges: DataFrame, papers: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(seed_id, name, n_papers, rank): papers that share a seed, from edges in either direction, each paper once a seed."""
    ends = edges.select(F.col("source_id").alias("paper_id"), F.col("target_id").alias("seed_id")).union(edges.select("target_id", "source_id"))
    linked = ends.where(F.rlike("seed_id", F.lit(PREFIXES))).distinct()
    linked = linked.join(papers.select(F.col("paper_id").cast("string").alias("paper_id")), "paper_id", "left_semi")
    sizes = linked.groupBy("seed_id").agg(F.count("*").alias("n_papers"))
    if seeds is not None:
        sizes = sizes.join(F.broadcast(seeds.select(F.col("node_id").alias("seed_id"), "name")), "seed_id", "left")
    named = sizes.withColumn("name", F.coalesce("name", "seed_id") if seeds is not None else F.col("seed_id"))
    return named.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_papers"), "seed_id")))


def near_members(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(seed_id, paper_id, title, score): members of each cluster with their strongest link."""
    ends = edges.select(F.col("source_id").alias("paper_id"), F.col("target_id").alias("seed_id"), "base_score").union(edges.select("target_id", "source_id", "base_score"))
    best = ends.where(F.rlike("seed_id", F.lit(PREFIXES))).groupBy("seed_id", "paper_id").agg(F.max("base_score").alias("score"))
    return best.join(papers.select(F.col("paper_id").cast("string").alias("paper_id"), "title"), "paper_id")


def first_score(edges: DataFrame, pos: str = "seq") -> DataFrame:
    """(paper_id, label): the first score edge of each paper in scan order."""
    kind = F.when(F.contains("target_id", F.lit("b1-")), 1).when(F.contains("target_id", F.lit("b2-")), 2)
    rows = edges.withColumn("_k", kind).where("_k IS NOT NULL").groupBy(F.col("source_id").alias("paper_id")).agg(F.min_by(F.struct("_k", "base_score"), pos).alias("_f"))
    return rows.select("paper_id", F.when(F.col("_f._k") == 1, F.format_string("B1:%.3f", "_f.base_score")).otherwise(F.format_string("B2:%.1f", "_f.base_score")).alias("label"))


def far_transfer(papers: DataFrame, *, pattern: Column, core: Column, architecture: Column, domain: Column, id: str = "paper_id") -> DataFrame:
    """(kind, value, n_papers, n_domains) of papers with the same structure; two papers or more make a cluster.

    Patterns count if longer than five characters, the others if longer than three.
    """
    rows = papers.select(F.col(id), text_or_empty(domain).alias("domain"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), text_or_empty(c).alias("value"), F.lit(m).alias("m")) for k, c, m in (("pattern", pattern, 5), ("math_core", core, 3), ("architecture", architecture, 3))])).alias("s"))
    rows = rows.select(id, "domain", "s.*").where(F.length("value") > F.col("m"))
    found = rows.groupBy("kind", "value").agg(F.count("*").alias("n_papers"), F.countDistinct(F.nullif("domain", F.lit(""))).alias("n_domains"))
    return found.where("n_papers >= 2")


def groups(papers: DataFrame, by: Column, most: int = 5, unnamed: str = "(unspecified)") -> DataFrame:
    """(value, n, links, levels): papers of a domain or pattern, the first ``most`` ids as links."""
    value = F.coalesce(F.nullif(F.trim(text_or_empty(by)), F.lit("")), F.lit(unnamed))
    rows = papers.withColumn("value", value)
    place = W.partitionBy("value").orderBy("pos")
    few = rows.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "paper_id"))), lambda x: x["paper_id"]).alias("links"))
    levels = rows.select("value", F.explode_outer("knowledge_level").alias("l")).groupBy("value").agg(F.array_sort(F.collect_set("l")).alias("levels"))
    return rows.groupBy("value").agg(F.count("*").alias("n")).join(few, "value").join(levels, "value")


def knowledge_tree(papers: DataFrame, seeds: DataFrame, most: int = 8) -> DataFrame:
    """(branch, name, n, shown, more): seeds by level, papers by year and by level, the first ``most`` of each."""
    members = (
        seeds.select(F.lit("seeds").alias("branch"), F.concat(F.lit("L"), F.col("level").cast("string")).alias("name"), F.col("name").alias("item"), F.col("seed_pos").cast("long").alias("o"))
        .union(papers.select(F.lit("years"), F.col("year").cast("string"), "title", F.col("pos").cast("long")))
        .union(papers.select(F.lit("levels"), F.explode("knowledge_level"), "title", F.col("pos").cast("long")))
    )
    counts = members.groupBy("branch", "name").agg(F.count("*").alias("n"))
    few = members.withColumn("_n", F.row_number().over(W.partitionBy("branch", "name").orderBy("o"))).where(F.col("_n") <= most)
    shown = few.groupBy("branch", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "item"))), lambda x: x["item"]).alias("shown"))
    return counts.join(shown, ["branch", "name"]).withColumn("more", F.greatest(F.lit(0), F.col("n") - most))


def phase_counters(events: DataFrame) -> DataFrame:
    """(p, started, ended, scored, errors, degradations, tokens, elapsed_s, status) of each phase in an event log (t, e, p, rest)."""
    number = lambda k: F.coalesce(F.try_element_at("rest", F.lit(k)).try_cast("long"), F.lit(0))
    of = lambda *k: F.count_if(F.col("e").isin(*k))
    rows = events.groupBy("p").agg(
        of("phase_start").alias("started"), of("phase_end").alias("ended"), of("item_scored").alias("scored"), of("item_error", "error").alias("errors"), of("degradation").alias("degradations"),
        F.sum(number("tokens_in") + number("tokens_out")).alias("tokens"), (F.max("t").cast("timestamp").cast("double") - F.min("t").cast("timestamp").cast("double")).alias("elapsed_s"),
    )
    return rows.withColumn("status", F.when(F.col("ended") > 0, F.when(F.col("errors") > 0, "done_with_errors").otherwise("done")).when(F.col("started") > 0, "running").otherwise("pending"))
