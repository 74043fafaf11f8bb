"""Node and edge tables: keyed upserts, causal promotion, the graph of a run, incidence and statistics.

Plain Parquet tables have no MERGE, so a table is a set of versions ordered by ``seq``
and its current state the latest version of each id.  Replacing a node keeps its edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import model
from ..functions.text import edge_id, text_or_empty
from ..sources.tables import stored
from .ranking import ranked

CONDITIONS = ("temporal_precedence", "mechanistic_chain", "intervention_test", "boundary_conditions")
STRONG = 0.3
PAIR_FLOOR = 0.2
#: Papers of a block of ``pairs`` at least, and blocks at most.
WIDTH, BLOCKS = 256, 64


def empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def latest(versions: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The newest version of each key, by an aggregate (no sort of a key's versions)."""
    newest = versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), seq).alias("_r"))
    return newest.select("_r.*")


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Current rows with ``rows`` in place of those they share a key with; of equal keys in ``rows`` the largest seq counts."""
    new = latest(rows, key)
    return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def with_ids(rows: DataFrame, prefix: str = "node") -> DataFrame:
    """Rows without an id get one from a hash of their content, so a rerun gives the same."""
    return rows.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit(f"{prefix}-"), F.lower(F.hex(F.xxhash64(*[c for c in ("type", "title", "year") if c in rows.columns]))))))


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def patch(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the columns of ``changes`` that are not null; keys that do not exist are not added."""
    columns = [c for c in changes.columns if c != key]
    order = F.col("seq") if "seq" in columns else F.lit(0)
    columns = [c for c in columns if c != "seq"]
    # of several values of a key the one with the largest seq counts, of equal seq the one with the largest hash: no order of rows
    one = changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, F.xxhash64(F.to_json(F.struct(c)))))).alias(f"_n_{c}") for c in columns])
    out = table.join(one, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_n_{c}"), F.col(c)))
    return out.select(*table.columns)


def append(log: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Log rows after the last one, numbered on in their order ``seq``."""
    last = log.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))
    placed = ranked(rows, "seq", name="_place")
    return log.unionByName(placed.join(F.broadcast(last)).withColumn(key, (F.col("_last") + F.col("_place")).cast("long")).drop("_last", "_place", "seq"), allowMissingColumns=True)


def correlation(source: Column, target: Column, score: Column, why: Column | None = None) -> list[Column]:
    """Columns of an edge that is a correlation and not (yet) causal."""
    promotion = F.struct(
        F.lit(False).alias("is_causal"),
        F.array().cast("array<string>").alias("conditions_met"),
        F.lit(0.0).alias("confidence"),
        F.lit(None).cast("timestamp").alias("last_evaluated"),
        F.create_map().cast("map<string,boolean>").alias("promotion_path"),
    )
    return [
        edge_id(source, target).alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit("correlation").alias("base_type"), score.cast("double").alias("base_score"),
        promotion.alias("causal_promotion"), (why if why is not None else F.lit("")).alias("mechanism_description"), F.array().cast(model.HISTORY).alias("history"),
    ]


def pairs(scored: DataFrame, *, id: str = "paper_id", score: str = "dry_score", floor: float = PAIR_FLOOR, most: int | None = None, pos: str = "pos") -> DataFrame:
    """(source_id, target_id, base_score, rank): all pairs of papers above the floor, the better one first, with the lower score.

    The result has k (k - 1) / 2 rows for k papers above the floor, by definition; ``most`` bounds k to the best.
    """
    # scored once: the floor would score each paper a second time, and the ranges all of them again
    best = stored(scored.select(F.col(id).cast("string").alias("i"), F.col(score).alias("s"), F.col(pos).alias("_pos")), "pair-scores").where(F.col("s") > floor)
    if most is not None:
        best = best.orderBy(F.desc("s"), "_pos").limit(most)
    best = ranked(best, F.desc("s"), "_pos", name="rn").drop("_pos")
    a, b = tiles(best)
    # sent to the tasks, as a broadcast would hold all copies of a side
    return a.join(b.hint("merge"), ["x", "y"]).where("a_rn < b_rn").select("source_id", "target_id", "base_score", F.col("a_rn").cast("long").alias("rank"))


def tiles(best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers (i, s) by place ``rn``, as first and as second of a pair, in the tiles (x, y) of their blocks.

    That is an equi-join in place of a product; a paper is in at most ``BLOCKS`` tiles, however many papers there are.
    """
    last = best.agg(F.max("rn").alias("_last")).withColumn("_width", F.greatest(F.lit(WIDTH), F.ceil(F.col("_last") / BLOCKS)))
    block = lambda c: F.floor((F.col(c) - 1) / F.col("_width"))
    placed = best.join(F.broadcast(last))
    a = placed.select(F.col("i").alias("source_id"), F.col("rn").alias("a_rn"), block("rn").alias("x"), F.explode(F.sequence(block("rn"), block("_last"))).alias("y"))
    b = placed.select(F.col("i").alias("target_id"), F.col("s").alias("base_score"), F.col("rn").alias("b_rn"), F.explode(F.sequence(F.lit(0).cast("long"), block("rn"))).alias("x"), block("rn").alias("y"))
    return a, b


def build(papers: DataFrame, dry: DataFrame, reviewed: DataFrame | None = None, matches: DataFrame | None = None, seeds: DataFrame | None = None, *, most_pairs: int | None = None, paired: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a run: papers, their scores, links of papers (unless ``paired`` is false) and of seeds; the last write of an id wins."""
    pid = F.col("paper_id").cast("string")
    none = F.array().cast("array<string>")

    def node(id_: Column, kind: str, title: Column, year: Column, levels: Column = none) -> list[Column]:
        return [id_.alias("id"), F.lit(kind).alias("type"), title.alias("title"), year.cast("int").alias("year"), levels.alias("knowledge_level")]

    nodes = papers.select(*node(pid, "paper", F.col("title"), F.coalesce(F.col("year"), F.lit(0)))).withColumn("seq", F.lit(1))
    dry = stored(dry.select("paper_id", "dry_score", "pos", *([F.col("dry_detail")] if "dry_detail" in dry.columns else [])), "dry-scores")
    good = dry.where((pid != "") & (F.col("dry_score") > 0))
    b1 = F.concat(F.lit("b1-"), pid)
    nodes = nodes.unionByName(good.select(*node(b1, "score", F.format_string("B1:%.3f", "dry_score"), F.lit(0))).withColumn("seq", F.lit(2)))
    edges = good.select(*correlation(pid, b1, F.col("dry_score"), F.format_string("BM25=%.2f Intent=%.2f", "dry_detail.bm25", "dry_detail.intent") if "dry_detail" in dry.columns else None)).withColumn("seq", F.lit(2))
    if reviewed is not None:
        read = reviewed.where((pid != "") & (F.col("mean_score") > 0))
        b2 = F.concat(F.lit("b2-"), pid)
        nodes = nodes.unionByName(read.select(*node(b2, "score", F.format_string("B2:%.1f", "mean_score"), F.lit(0))).withColumn("seq", F.lit(3)))
        edges = edges.unionByName(read.select(*correlation(pid, b2, F.col("mean_score") / 5.0)).withColumn("seq", F.lit(3)))
    if paired:
        linked = pairs(dry, most=most_pairs)
        edges = edges.unionByName(linked.select(*correlation(F.col("source_id"), F.col("target_id"), F.col("base_score"))).withColumn("seq", F.lit(4)))
    if matches is not None:
        scores = matches.select(pid.alias("p"), F.explode("match_scores").alias("s", "v"))
        edges = edges.unionByName(scores.select(*correlation(F.col("p"), F.col("s"), F.col("v"), F.format_string("seed match: %.3f", "v"))).withColumn("seq", F.lit(5)))
    if seeds is not None:
        from .seeds import label

        nodes = nodes.unionByName(seeds.select(*node(F.col("node_id"), "seed", F.col("name"), F.lit(0), F.array(label(F.col("level"), F.col("category"))))).withColumn("seq", F.lit(0)))
    return latest(nodes), latest(edges)


def seeded(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes with the seeds added if there are no nodes yet; one aggregate decides."""
    from .seeds import label

    n = nodes.agg(F.count("*").alias("_n"))
    rows = seeds.select(F.col("node_id").alias("id"), F.lit("seed").alias("type"), F.col("name").alias("title"), F.lit(0).alias("year"), F.array(label(F.col("level"), F.col("category"))).alias("knowledge_level"))
    return nodes.unionByName(rows.join(F.broadcast(n)).where("_n = 0").drop("_n"), allowMissingColumns=True)


def _flag(c: str) -> Column:
    return F.coalesce(F.col(f"causal_promotion.{c}"), F.lit(False))


def causal(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("base_type") == "causation") & _flag("is_causal"))


def edge_class(edges: DataFrame) -> DataFrame:
    kind = F.when((F.col("base_type") == "causation") | _flag("is_causal"), "causal").when(F.col("base_score") > STRONG, "strong").otherwise("weak")
    return edges.withColumn("class", kind)


def incident(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(node_id, other_id, id, base_score): each edge from both its ends, once for a self-loop; of some nodes if ``ids`` is given."""
    out = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("other_id"), "id", "base_score").union(
        edges.where("source_id <> target_id").select(F.col("target_id").alias("node_id"), F.col("source_id").alias("other_id"), "id", "base_score")
    )
    return out if ids is None else out.join(ids.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")


def neighbours(edges: DataFrame, nodes: DataFrame, kind: str | None = None, most: int | None = None) -> DataFrame:
    """(node_id, other_id, title, base_score) of linked nodes; the ``most`` strongest of each node."""
    named = nodes if kind is None else nodes.where(F.col("type") == kind)
    out = incident(edges).join(named.select(F.col("id").alias("other_id"), "title"), "other_id").select("node_id", "other_id", "title", "base_score", "id")
    if most is not None:
        order = W.partitionBy("node_id").orderBy(F.desc("base_score"), "id")
        out = out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    return out.drop("id")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; an edge counts as causal by its type or its flag."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "paper").alias("papers"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if((F.col("base_type") == "causation") | _flag("is_causal")).alias("causal_edges"))
    return n.join(F.broadcast(e))


def promotion_check(edges: DataFrame) -> DataFrame:
    """Edges with promotion = struct(status, met, unmet, confidence): which of the four conditions hold; two make it ready."""
    path = lambda c: F.try_element_at(F.col("causal_promotion.promotion_path"), F.lit(c))
    described = F.length(F.trim(text_or_empty(F.col("mechanism_description")))) > 20
    holds = {c: F.coalesce(path(c), described if c == "mechanistic_chain" else F.lit(False)) for c in CONDITIONS}
    met = F.filter(F.array(*[F.when(v, c) for c, v in holds.items()]), lambda x: x.isNotNull())
    unmet = F.filter(F.array(*[F.when(~v, c) for c, v in holds.items()]), lambda x: x.isNotNull())
    done = _flag("is_causal")
    had = F.coalesce(F.col("causal_promotion.conditions_met"), F.array().cast("array<string>"))
    return edges.withColumn(
        "promotion",
        F.struct(
            F.when(done, "already_causal").when(F.size(met) >= 2, "ready").otherwise("not_ready").alias("status"),
            F.when(done, had).otherwise(met).alias("met"),
            F.when(done, F.array().cast("array<string>")).otherwise(unmet).alias("unmet"),
            F.when(done, F.coalesce(F.col("causal_promotion.confidence"), F.lit(0.0))).otherwise(F.size(met) / 4.0).alias("confidence"),
        ),
    )


def _entry(action: str, at: Column, details: Column) -> Column:
    return F.array(F.struct(F.lit(action).alias("action"), at.cast("timestamp").alias("timestamp"), details.alias("details")))


def promote(edges: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """Edges with requests (id, conditions, confidence) applied; ``error`` says why one was not.

    An edge becomes causal with at least one of the four conditions, unless it already is.
    """
    rows = edges.join(requests.select("id", "conditions", F.col("confidence").alias("_c")), "id", "left")
    valid = F.filter(F.coalesce("conditions", F.array().cast("array<string>")), lambda x: x.isin(*CONDITIONS))
    asked = F.col("conditions").isNotNull()
    error = F.when(asked & _flag("is_causal"), "already causal").when(asked & (F.size(valid) == 0), "no valid condition")
    go = asked & error.isNull()
    held = F.map_from_entries(F.transform(valid, lambda c: F.struct(c, F.lit(True))))
    old = F.coalesce(F.col("causal_promotion.promotion_path"), F.create_map().cast("map<string,boolean>"))
    path = F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(valid, k)), held)
    promoted = F.struct(F.lit(True).alias("is_causal"), F.array_distinct(valid).alias("conditions_met"), F.coalesce(F.col("_c"), F.size(valid) / 4.0).alias("confidence"), at.cast("timestamp").alias("last_evaluated"), path.alias("promotion_path"))
    entry = _entry("promoted", at, F.create_map(F.lit("conditions"), F.concat_ws(",", valid)))
    return rows.withColumns(
        {
            "base_type": F.when(go, "causation").otherwise(F.col("base_type")),
            "causal_promotion": F.when(go, promoted).otherwise(F.col("causal_promotion")),
            "history": F.when(go, F.concat(F.coalesce("history", F.array().cast(model.HISTORY)), entry)).otherwise(F.col("history")),
            "error": error,
        }
    ).drop("conditions", "_c")


def downgrade(edges: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """Edges with requests (id, reason) applied: causal ones turn back into correlations, and their history says what they were."""
    rows = edges.join(requests.select("id", "reason"), "id", "left")
    asked = F.col("reason").isNotNull()
    error = F.when(asked & ~_flag("is_causal"), "not causal")
    go = asked & error.isNull()
    was = F.col("causal_promotion")
    details = F.create_map(F.lit("reason"), F.col("reason"), F.lit("conditions"), F.concat_ws(",", was["conditions_met"]), F.lit("confidence"), was["confidence"].cast("string"))
    plain = F.struct(F.lit(False).alias("is_causal"), F.array().cast("array<string>").alias("conditions_met"), F.lit(0.0).alias("confidence"), at.cast("timestamp").alias("last_evaluated"), was["promotion_path"].alias("promotion_path"))
    return rows.withColumns(
        {
            "base_type": F.when(go, "correlation").otherwise(F.col("base_type")),
            "history": F.when(go, F.concat(F.coalesce("history", F.array().cast(model.HISTORY)), _entry("downgraded", at, details))).otherwise(F.col("history")),
            "causal_promotion": F.when(go, plain).otherwise(was),
            "error": error,
        }
    ).drop("reason")


def score_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rank, paper_id, year, b1, b2, title): papers by their best review score, then dry score, then title."""
    papers = nodes.where("type = 'paper'").select(F.col("id").alias("paper_id"), "year", "title")
    scores = nodes.where("type = 'score'").select(F.col("id").alias("other_id"), F.col("title").alias("_t"))
    seen = incident(edges).join(scores, "other_id")
    second = F.contains("_t", F.lit("B2")) | F.contains(F.lower("other_id"), F.lit("b2"))
    best = seen.groupBy(F.col("node_id").alias("paper_id")).agg(F.max(F.when(~second, F.col("base_score"))).alias("b1"), F.max(F.when(second, F.col("base_score"))).alias("b2"))
    rows = papers.join(best, "paper_id", "left").withColumn("b1", F.coalesce("b1", F.lit(0.0))).withColumn("b2", F.coalesce("b2", F.lit(0.0)))
    return ranked(rows, F.desc("b2"), F.desc("b1"), "title", "paper_id")
