"""Changes of the ontology: who decides, what they do to the node and edge tables, and distillation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import jaccard, parent_level, text_or_empty, word_set
from ..model import Policy
from ..sources.tables import stored
from .components import components
from .graph import correlation, incident, upsert
from .ranking import ranked

TRUTHS = ("dissatisfaction", "intelligibility", "plausibility", "fruitfulness")
TRIGGERS = ("double_loop", "ontology_change_applied")
#: Nodes of one class that a task pairs with another node at a time.
SLICE = 1024


def impact(changes: Column, nodes: Column) -> Column:
    """Share of the nodes that a list of changes is taken to touch, 1 at most; ``changes`` is an array of their types."""
    n = nodes.cast("double")
    weight = lambda c: F.when(c == "new_level", F.least(F.lit(3.0), n * 0.1)).when(c.isin("reparent", "merge"), 2.0).when(c == "split", 3.0).otherwise(0.0)
    total = F.aggregate(F.coalesce(changes, F.array().cast("array<string>")), F.lit(0.0), lambda a, c: a + weight(c))
    return F.when((n <= 1) | (total == 0), 0.0).otherwise(F.least(F.lit(1.0), total / n))


def true_conditions(conditions: dict[str, Column]) -> Column:
    """How many of the four conditions are true (and not null)."""
    return sum((F.coalesce(conditions[c], F.lit(False)).cast("int") for c in TRUTHS), F.lit(0))


def decide(nodes: Column, consecutive: Column, score: Column, conditions: Column, touched: Column, policy: Policy = Policy()) -> Column:
    """The action that the policy allows for a conflict."""
    enough = (conditions >= 2) if policy.require_two_conditions else F.lit(True)
    return (
        F.when(nodes < policy.cold_start_nodes, "seed_anchored")
        .when(consecutive >= policy.consecutive_trigger_limit, "degraded_by_meta")
        .when(F.coalesce(score, F.lit(0.0)) < policy.threshold, "single_loop")
        .when(~enough, "single_loop")
        .when(touched > policy.max_impact_ratio, "degraded_by_meta")
        .otherwise("double_loop")
    )


def guard(recommended: Column, nodes: Column, consecutive: Column, conditions: Column, touched: Column, policy: Policy = Policy()) -> Column:
    """struct(applied boolean, reason string) for a recommended change."""
    few = (conditions < 2) if policy.require_two_conditions else F.lit(False)
    reason = (
        F.when(~F.coalesce(recommended, F.lit("single_loop")).isin("double_loop", "seed_anchored"), F.concat(F.lit("recommended_action="), F.coalesce(recommended, F.lit("single_loop"))))
        .when(recommended == "seed_anchored", "")
        .when(consecutive >= policy.consecutive_trigger_limit, "consecutive_trigger_limit")
        .when(few, "insufficient_conditions")
        .when(touched > policy.max_impact_ratio, "impact_ratio_exceeded")
        .otherwise("")
    )
    return F.struct((reason == "").alias("applied"), reason.alias("reason"))


def consecutive_triggers(events: DataFrame, *, by: Sequence[str] = (), seq: str = "id", action: str = "action", window: int | None = 5, triggers: Sequence[str] = TRIGGERS) -> DataFrame:
    """(by..., consecutive): how many of the newest events in a row are triggers, of the last ``window``."""
    newest = W.partitionBy(*by).orderBy(F.desc(seq))
    rows = events.withColumn("_n", F.row_number().over(newest))
    if window is not None:
        rows = rows.where(F.col("_n") <= window)
    rows = rows.withColumn("_run", F.min(F.coalesce(F.col(action), F.lit("")).isin(*triggers).cast("int")).over(newest.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by).agg(F.coalesce(F.sum("_run"), F.lit(0)).cast("long").alias("consecutive"))


def resolve(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(ref) to (ref, id): by id, else by the first title that is equal."""
    by_id = nodes.select(F.col("id").alias("ref"), F.col("id").alias("_a"))
    by_title = nodes.groupBy(F.col("title").alias("ref")).agg(F.min("id").alias("_b"))
    return asked.join(by_id, "ref", "left").join(by_title, "ref", "left").select("ref", F.coalesce("_a", "_b").alias("id"))


def _edge(source: Column, target: Column, score: float, why: str) -> list[Column]:
    return correlation(source, target, F.lit(score), F.lit(why))


def insert_level(nodes: DataFrame, edges: DataFrame, name: str, parent: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A level under its parent: (nodes, edges, log)."""
    spark = nodes.sparkSession
    id_ = f"level-{name}"
    new = spark.range(1).select(F.lit(id_).alias("id"), F.lit("level").alias("type"), F.lit(name).alias("title"), F.lit(0).alias("year"), F.array(F.lit(name)).alias("knowledge_level"), F.lit(1 << 40).cast("long").alias("seq"))
    found = resolve(nodes, spark.createDataFrame([(parent,)], "ref string")).where("id IS NOT NULL")
    link = found.select(*_edge(F.lit(id_), F.col("id"), 0.8, "level under its parent")).withColumn("seq", F.lit(1 << 40).cast("long"))
    return upsert(nodes, new), upsert(edges, link), _log(found, "new_level", F.lit(f"{name} under {parent}"))


def reparent(nodes: DataFrame, edges: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves (node, parent), by id or title: an edge of score 1 is added, and the log notes the parents that stay: (edges, log)."""
    a = resolve(nodes, moves.select(F.col("node").alias("ref")).distinct()).withColumnsRenamed({"ref": "node", "id": "n_id"})
    b = resolve(nodes, moves.select(F.col("parent").alias("ref")).distinct()).withColumnsRenamed({"ref": "parent", "id": "p_id"})
    found = moves.join(a, "node").join(b, "parent").where("n_id IS NOT NULL AND p_id IS NOT NULL AND n_id <> p_id")
    kinds = nodes.select(F.col("id").alias("other_id"), F.col("type").alias("_kind"))
    old = incident(edges).join(kinds, "other_id").where(F.col("_kind").isin("level", "seed")).groupBy(F.col("node_id").alias("n_id")).agg(F.array_sort(F.collect_set("other_id")).alias("_old"))
    new = found.select(*_edge(F.col("n_id"), F.col("p_id"), 1.0, "moved to a new parent")).withColumn("seq", F.lit(1 << 40).cast("long"))
    log = _log(found.join(old, "n_id", "left"), "reparent", F.concat_ws(" ", F.lit("moved"), "n_id", F.lit("to"), "p_id", F.lit("beside"), F.concat_ws(",", "_old")))
    return upsert(edges, new), log


def merge(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges (a, b) of ids, each id in one merge: b's edges are copied onto a without self-loops, a gets both titles, b stays.

    Where a already has such an edge, it is kept; of two edges of b that become the same, the stronger one.
    """
    names = nodes.select("id", "title")
    known = merges.join(names.withColumnsRenamed({"id": "a", "title": "_ta"}), "a").join(names.withColumnsRenamed({"id": "b", "title": "_tb"}), "b").where("a <> b")
    onto = known.select(F.col("b").alias("_from"), F.col("a").alias("_to"))
    moved = edges
    for end in ("source_id", "target_id"):
        moved = moved.join(onto.withColumnsRenamed({"_from": end, "_to": f"_{end}"}), end, "left")
    moved = moved.where(F.col("_source_id").isNotNull() | F.col("_target_id").isNotNull())
    moved = moved.withColumn("source_id", F.coalesce("_source_id", "source_id")).withColumn("target_id", F.coalesce("_target_id", "target_id")).where("source_id <> target_id")
    moved = moved.withColumn("id", F.concat(F.lit("edge::"), F.col("source_id"), F.lit("::"), F.col("target_id"))).select(*edges.columns)
    best = moved.groupBy("id").agg(F.max_by(F.struct(*moved.columns), F.struct("base_score", "source_id")).alias("_r")).select("_r.*")
    have = edges.select("source_id", "target_id")
    added = best.join(have, ["source_id", "target_id"], "left_anti")
    titles = known.select(F.col("a").alias("id"), F.concat_ws(" + ", "_ta", "_tb").alias("_title"))
    renamed = nodes.join(titles, "id", "left").withColumn("title", F.coalesce("_title", "title")).drop("_title")
    return renamed.select(*nodes.columns), edges.unionByName(added.select(*edges.columns))


def split(nodes: DataFrame, edges: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits (id, children array of names): a child node each, an edge of score 0.9 to the parent, and the parent marked."""
    known = splits.join(nodes.select("id", "title", "type", "knowledge_level"), "id")
    child = known.select("id", "type", "knowledge_level", F.posexplode("children").alias("_i", "_name"))
    cid = F.concat(F.col("id"), F.lit("-"), (F.col("_i") + 1).cast("string"))
    new = child.select(cid.alias("id"), "type", F.col("_name").alias("title"), F.lit(0).alias("year"), "knowledge_level", F.lit(1 << 40).cast("long").alias("seq"))
    links = child.select(*_edge(cid, F.col("id"), 0.9, "part of a split node")).withColumn("seq", F.lit(1 << 40).cast("long"))
    parents = nodes.join(known.select("id", F.lit(True).alias("_cut")), "id", "left").withColumn("title", F.when(F.col("_cut"), F.concat("title", F.lit(" (split)"))).otherwise(F.col("title"))).select(*nodes.columns)
    return upsert(parents, new), upsert(edges, links)


def _log(rows: DataFrame, kind: str, description: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("change_type"), description.alias("description"), F.lit("system").alias("trigger_paper"), F.monotonically_increasing_id().alias("seq"))


def apply(nodes: DataFrame, edges: DataFrame, report: dict, *, consecutive: int = 0, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame, list[dict]]:
    """A conflict report's changes, behind the guard: (nodes, edges, log of what was done, blocked or failed).

    A report has a handful of changes and is a value of the driver; the tables are not gathered.
    """
    assessment, changes = report.get("conflict_assessment", {}), report.get("changes", [])
    wanted = assessment.get("recommended_action", "single_loop")
    held = sum(1 for c in TRUTHS if (assessment.get("conceptual_change_conditions", {}).get(c) or {}).get("value") is True)
    kinds = F.array(*[F.lit(str(c.get("type", ""))) for c in changes]) if changes else F.array().cast("array<string>")
    count = nodes.agg(F.count("*").alias("n"))
    verdict = count.select(guard(F.lit(wanted), F.col("n"), F.lit(consecutive), F.lit(held), impact(kinds, F.col("n")), policy).alias("v")).first()["v"]
    if not verdict["applied"]:
        blocked = not verdict["reason"].startswith("recommended_action")
        return nodes, edges, [{"change_type": "double_loop_blocked" if blocked else "skipped", "reason": verdict["reason"]}]
    spark, log = nodes.sparkSession, []
    for c in changes:
        try:
            kind = c["type"]
            if kind == "new_level":
                nodes, edges, _ = insert_level(nodes, edges, c["level_name"], c["parent_level"])
            elif kind == "reparent":
                edges, _ = reparent(nodes, edges, spark.createDataFrame([(c["node_id"], c["new_parent"])], "node string, parent string"))
            elif kind == "merge":
                nodes, edges = merge(nodes, edges, spark.createDataFrame([(c["node_a"], c["node_b"])], "a string, b string"))
            elif kind == "split":
                nodes, edges = split(nodes, edges, spark.createDataFrame([(c["node_id"], c["new_children"])], "id string, children array<string>"))
            else:
                raise ValueError(f"unknown change {kind}")
            nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
            log.append({"change_type": kind, "reason": ""})
        except (KeyError, TypeError, ValueError) as e:  # a malformed change does not stop the others
            log.append({"change_type": "error", "reason": f"{type(e).__name__}: {e}"})
    log.append({"change_type": "ontology_change_applied", "reason": f"{sum(x['change_type'] != 'error' for x in log)} of {len(changes)}"})
    return nodes, edges, log


def _siblings(nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, level, w) of the nodes with words, and (level, wa, wb) of the word sets that overlap by ``least`` or more, each with itself too.

    Prefix filter: a pair that reaches the overlap shares one of the first
    n - ceil(least * n) + 1 words of each, in order of rarity, so levels are not paired with themselves.
    """
    told = F.concat_ws(" ", text_or_empty(F.col("title")), *([text_or_empty(F.col("structure_template.abstract_pattern")), text_or_empty(F.col("structure_template.mathematical_core"))] if "structure_template" in nodes.columns else []))
    rows = nodes.select("id", F.explode("knowledge_level").alias("level"), F.array_sort(word_set(told, 2)).alias("w")).withColumn("level", F.trim("level")).where("size(w) > 0").distinct()
    # equal sets of words are one class, so a thousand nodes of one name share one prefix
    sets = rows.select("level", "w").distinct()
    rare = sets.select("level", F.explode("w").alias("x")).groupBy("level", "x").agg(F.count("*").alias("n"))
    ranked_ = sets.select("level", "w", F.explode("w").alias("x")).join(rare, ["level", "x"]).groupBy("level", "w").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("o"))
    size = F.size("w")
    prefix = ranked_.select("level", "w", F.explode(F.transform(F.slice("o", F.lit(1), (size - F.ceil(size * F.lit(least) - 1e-9) + 1).cast("int")), lambda s: s["x"])).alias("x"))
    a, b = prefix.select("level", "x", F.col("w").alias("wa")), prefix.select("level", "x", F.col("w").alias("wb"))
    close = (F.least(F.size("wa"), F.size("wb")) >= F.greatest(F.size("wa"), F.size("wb")) * least - 1e-9) & (jaccard(F.col("wa"), F.col("wb")) >= least)
    return rows, a.join(b, ["level", "x"]).where(close).select("level", "wa", "wb").distinct()


def sibling_pairs(nodes: DataFrame, least: float = Policy.merge_jaccard) -> DataFrame:
    """(level, a, b, similarity) of all nodes of a level whose words overlap by ``least`` or more, a before b: k (k - 1) / 2 rows for k of one name.

    Words are compared once a pair of classes, not of nodes; a class is dealt to slices, so that no task has all of it.
    """
    rows, near = _siblings(nodes, least)
    members = rows.where("id IS NOT NULL").select("level", F.xxhash64("id").alias("h"), "id", "w")
    slices = members.groupBy("level", "w").agg(F.ceil(F.count("*") / SLICE).alias("n"))
    near = near.withColumn("similarity", F.round(jaccard(F.col("wa"), F.col("wb")), 3)).join(slices.withColumnRenamed("w", "wb"), ["level", "wb"])
    near = stored(near.select("level", "wa", "wb", "n", "similarity", F.monotonically_increasing_id().alias("c")), "sibling-classes")
    first = near.join(members.select("level", F.col("w").alias("wa"), F.col("id").alias("a")), ["level", "wa"]).select("level", "a", "similarity", "c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("slice"))
    second = near.join(members.select("level", F.col("w").alias("wb"), F.col("id").alias("b"), "h"), ["level", "wb"]).select("c", (F.pmod("h", "n") + 1).alias("slice"), "b")
    return first.join(second.hint("merge"), ["c", "slice"]).where("a < b").select("level", "a", "b", "similarity")


def sibling_merges(nodes: DataFrame, least: float = Policy.merge_jaccard) -> DataFrame:
    """(level, a, b, similarity): what ``disjoint_merges`` takes of ``sibling_pairs``, without these pairs.

    Nodes of equal words are a class.  In order of id a node takes the first one near it that waits, or waits
    itself, which gives the same merges as the pairs in order, since every node prefers its smaller partners in both.  So no class
    ever has more than one that waits.  A class near no other is paired by places, in all tasks; classes
    near each other stream through one task, which holds their links and one waiting node of each.
    A level's turn comes when none of its nodes is still to be decided in an earlier one: all levels at once
    where no node has two.  Nodes without an id, a level or a word merge with none; of several texts of an id the smallest set of words counts.
    """
    rows, near = _siblings(nodes, least)
    name = lambda w: F.sha2(F.to_json(F.struct("level", F.col(w).alias("w"))), 256)
    links = stored(near.where("wa <> wb").select("level", name("wa").alias("c"), name("wb").alias("d"), F.round(jaccard(F.col("wa"), F.col("wb")), 3).alias("s")), "sibling-links")
    members = rows.where("id IS NOT NULL").groupBy("id", "level").agg(F.min("w").alias("w")).select("id", "level", name("w").alias("c"))
    roots = components(links.select(F.col("c").alias("u"), F.col("d").alias("v"))).select(F.col("u").alias("c"), "root")
    links = links.join(roots, "c").select("root", F.lit(None).cast("string").alias("id"), "level", "c", "d", "s")
    left = stored(members.join(roots, "c", "left"), "sibling-left")
    taken = left.sparkSession.createDataFrame([], "level string, a string, b string, similarity double")
    while not left.isEmpty():
        first = left.groupBy("id").agg(F.min("level").alias("_first"))
        ready = stored(left.join(first, "id").groupBy("level").agg(F.bool_and(F.col("level") == F.col("_first")).alias("_ready")).where("_ready").select("level"), "sibling-ready")
        now = left.join(ready, "level", "left_semi")
        linked = links.join(ready, "level", "left_semi").unionByName(now.where("root IS NOT NULL"), allowMissingColumns=True).select("root", "id", "level", "c", "d", "s")
        replayed = linked.repartition("root").sortWithinPartitions("root", F.asc_nulls_first("id")).mapInArrow(_meet_in_order, "level string, a string, b string, similarity double")
        won = stored(_paired(now.where("root IS NULL")).unionByName(replayed), "sibling-merges")
        taken = taken.unionByName(won)
        gone = won.select(F.explode(F.array("a", "b")).alias("id"))
        left = stored(left.join(ready, "level", "left_anti").join(gone, "id", "left_anti"), "sibling-left")
    return taken


def _paired(members: DataFrame) -> DataFrame:
    """Merges of (id, level, c) where only nodes of one class are near each other: the first with the second, the third with the fourth, and so on."""
    placed = ranked(members.select("c", "id", "level"), "c", "id", name="_place")
    start = placed.groupBy("c").agg(F.min("_place").alias("_start"))
    two = placed.join(start, "c").groupBy("c", F.floor((F.col("_place") - F.col("_start")) / 2)).agg(F.min("level").alias("level"), F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    return two.where("n = 2").select("level", "a", "b", F.lit(1.0).alias("similarity"))


def _meet_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, id, level, c, d, s) in order of root and id, a component's links (without an id) first, to its merges."""
    now = None
    near: dict[str, dict[str, float]] = {}
    waits: dict[str, str] = {}  # of each class the one node that waits
    kinds = [pa.string(), pa.string(), pa.string(), pa.float64()]
    for batch in batches:
        out = []
        for root, node, level, c, d, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if root != now:
                now, near, waits = root, {}, {}
            of = near.setdefault(c, {c: 1.0})
            if node is None:
                of[d] = s
                continue
            few, many = (of, waits) if len(of) < len(waits) else (waits, of)
            met = min((k for k in few if k in many), key=waits.__getitem__, default=None)
            if met is None:
                waits[c] = node
            else:
                out.append((level, waits.pop(met), node, of[met]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["level", "a", "b", "similarity"])


def disjoint_merges(pairs: DataFrame) -> DataFrame:
    """Pairs taken in order of (level, a, b) unless one of their nodes was taken before.

    Rounds: a pair that is the first of both its nodes is taken, and the pairs of its nodes go.
    """
    left = stored(pairs.select("level", "a", "b", "similarity"), "merge-pairs")
    taken = left.limit(0)
    while not left.isEmpty():
        key = F.struct("level", "a", "b")
        ends = left.select(F.explode(F.array("a", "b")).alias("n"), key.alias("k")).groupBy("n").agg(F.min("k").alias("k"))
        mine = left.withColumn("k", key).join(ends.withColumnsRenamed({"n": "a", "k": "ka"}), "a").join(ends.withColumnsRenamed({"n": "b", "k": "kb"}), "b")
        won = stored(mine.where("k = ka AND k = kb").select("level", "a", "b", "similarity"), "merge-won")
        taken = taken.unionByName(won)
        gone = won.select(F.explode(F.array("a", "b")).alias("n")).distinct()
        left = stored(left.join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "b"), "b", "left_anti").select("level", "a", "b", "similarity"), "merge-pairs")
    return taken


def collapses(nodes: DataFrame, least: int = Policy.min_nodes_per_level) -> DataFrame:
    """(level, n, parent_level) of levels with fewer than ``least`` nodes whose parent level has some."""
    n = nodes.select(F.explode("knowledge_level").alias("level")).withColumn("level", F.trim("level")).groupBy("level").agg(F.count("*").alias("n"))
    small = n.where(F.col("n") < least).withColumn("parent_level", parent_level(F.col("level"))).where("parent_level IS NOT NULL")
    return small.join(n.select(F.col("level").alias("parent_level")), "parent_level", "left_semi").select("level", "n", "parent_level")


def distil(nodes: DataFrame, edges: DataFrame, policy: Policy = Policy(), dry_run: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, merges, collapses): similar siblings merged and thin levels moved to their parents, or what would be."""
    merges, thin = stored(sibling_merges(nodes, policy.merge_jaccard), "merges"), stored(collapses(nodes, policy.min_nodes_per_level), "collapses")
    if not dry_run:
        members = nodes.select("id", F.explode("knowledge_level").alias("level")).withColumn("level", F.trim("level"))
        nodes, edges = merge(nodes, edges, merges.select("a", "b"))
        moves = members.join(thin, "level").select(F.col("id").alias("node"), F.col("parent_level").alias("parent"))
        edges, _ = reparent(nodes, edges, moves)
    return nodes, edges, merges, thin
