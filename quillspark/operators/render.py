"""Notes, indices, diagrams and graph files as text columns, and the sink that writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import file_name, text_or_empty
from ..sources import notes as note_files
from . import graph, reports


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text_or_empty(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def front_matter(fields: dict[str, Column]) -> Column:
    """A YAML front matter of typed columns; arrays become lists."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def yaml_list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), quoted), ", "), F.lit("]"))


def level_display(levels: Column) -> Column:
    return F.when(F.size(F.coalesce(levels, F.array().cast("array<string>"))) > 0, F.array_join(levels, ", ")).otherwise("—")


def mermaid_id(c: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(c, "[^A-Za-z0-9_]", "_"))


def mermaid_label(c: Column, most: int = 40) -> Column:
    return F.regexp_replace(F.substring(text_or_empty(c), 1, most), r'["\[\](){}|<>#]', " ")


def paper_notes(nodes: DataFrame, edges: DataFrame, related: int = 15) -> DataFrame:
    """(name, text) of a note for each paper: front matter, scores, the strongest related papers."""
    papers = nodes.where("type = 'paper'")
    index = graph.score_index(nodes, edges).select(F.col("paper_id").alias("id"), "b1", "b2", "rank")
    near = graph.neighbours(edges, nodes, "paper", related)
    lines = near.groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("base_score")).alias("o"), "other_id", "title"))), lambda x: F.concat(F.lit("- [["), file_name(x["other_id"]), F.lit("|"), text_or_empty(x["title"]), F.lit("]]"))), "\n").alias("near"))
    rows = papers.join(index, "id", "left").join(lines, "id", "left")
    head = front_matter({"id": quoted(F.col("id")), "title": quoted(F.col("title")), "year": F.coalesce(F.col("year"), F.lit(0)).cast("string"), "knowledge_level": yaml_list(F.col("knowledge_level")), "b1": F.format_string("%.4f", "b1"), "b2": F.format_string("%.4f", "b2")})
    body = F.concat(head, F.lit("\n# "), text_or_empty(F.col("title")), F.lit("\n\nLevels: "), level_display(F.col("knowledge_level")), F.lit("\n\n## Related\n\n"), F.coalesce("near", F.lit("none")), F.lit("\n"))
    return rows.select(F.concat(F.lit("papers/"), file_name(F.col("id")), F.lit(".md")).alias("name"), body.alias("text"))


def _lines(rows: DataFrame, line: Column, order: Column | str, name: str, head: str, foot: Column | None = None) -> DataFrame:
    """One text of a line a row, in order; indices are small tables of a run."""
    text = rows.agg(F.array_sort(F.collect_list(F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), line.alias("l")))).alias("x"), F.count("*").alias("n"))
    body = F.concat(F.lit(head), F.array_join(F.transform("x", lambda v: v["l"]), "\n"), F.lit("\n"))
    return text.select(F.lit(name).alias("name"), (F.concat(body, foot) if foot is not None else body).alias("text"))


def index_note(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = graph.score_index(nodes, edges)
    shown = lambda c: F.when(F.col(c) > 0, F.format_string("%.4f", c)).otherwise("—")
    line = F.concat_ws(" ", F.lit("|"), F.col("rank").cast("string"), F.lit("|"), F.concat(F.lit("[["), "paper_id", F.lit("]]")), F.lit("|"), F.col("year").cast("string"), F.lit("|"), shown("b1"), F.lit("|"), shown("b2"), F.lit("|"), F.replace(F.substring("title", 1, 50), F.lit("|"), F.lit("\\|")), F.lit("|"))
    return _lines(rows, line, "rank", "papers/index.md", "# Paper index\n\n| Rank | Paper | Year | B1 | B2 | Title |\n| --- | --- | --- | --- | --- | --- |\n", F.concat(F.lit("\n"), F.col("n").cast("string"), F.lit(" papers\n")))


def score_note(scored: DataFrame) -> DataFrame:
    """Totals and the histogram of dry scores."""
    total = reports.summary(scored)
    h = reports.histogram(scored).withColumn("total", F.lit(1))
    line = F.concat(F.lit("| "), F.col("bin"), F.lit(" | "), F.col("n").cast("string"), F.lit(" ("), F.col("bar"), F.lit(") | "), F.format_string("%.1f", "percent"), F.lit("% |"))
    note = _lines(h, line, "bin", "00-meta/scores.md", "\n| Range | Count | Percent |\n| --- | --- | --- |\n")
    head = F.concat(F.lit("# Dry scores\n\n- Total: "), F.col("total").cast("string"), F.lit("\n- Passed: "), F.col("passed").cast("string"), F.lit("\n- Mean: "), F.format_string("%.3f", "mean_score"), F.lit("\n"))
    return note.join(F.broadcast(total.select(head.alias("_h")))).select("name", F.concat("_h", "text").alias("text"))


def near_note(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    papers = nodes.where("type = 'paper'").select(F.col("id").alias("paper_id"), "title", "year")
    names = nodes.where("type = 'seed'").select(F.col("id").alias("node_id"), F.col("title").alias("name"))
    clusters = reports.near_transfer(edges, papers, names)
    members = reports.near_members(edges, papers)
    item = members.groupBy("seed_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "paper_id"))), lambda x: F.concat(F.lit("- [["), x["paper_id"], F.lit("|"), text_or_empty(x["title"]), F.lit("]]"))), "\n").alias("items"))
    rows = clusters.join(item, "seed_id")
    line = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n`"), F.col("seed_id"), F.lit("`: "), F.col("n_papers").cast("string"), F.lit(" papers\n\n"), F.col("items"), F.lit("\n"))
    return _lines(rows, line, "rank", "00-meta/near-transfer.md", "# Papers that share a seed\n\n", F.concat(F.lit("\nClusters: "), F.col("n").cast("string"), F.lit("\n")))


def far_note(papers: DataFrame) -> DataFrame:
    """Clusters of papers with the same structure (papers with ``structure_template``)."""
    t = F.col("structure_template")
    rows = reports.far_transfer(papers, pattern=t["abstract_pattern"], core=t["mathematical_core"], architecture=t["control_architecture"], domain=t["domain_abstraction"])
    line = F.concat(F.lit("- "), F.col("kind"), F.lit(" `"), F.col("value"), F.lit("`: "), F.col("n_papers").cast("string"), F.lit(" papers, "), F.col("n_domains").cast("string"), F.lit(" domains"))
    return _lines(rows, line, F.struct("kind", "value"), "00-meta/far-transfer.md", "# Papers of different fields with the same structure\n\n")


def tree_note(papers: DataFrame, seeds: DataFrame) -> DataFrame:
    rows = reports.knowledge_tree(papers, seeds)
    line = F.concat(F.lit("- "), F.col("branch"), F.lit(" / "), F.col("name"), F.lit(" ("), F.col("n").cast("string"), F.lit("): "), F.array_join("shown", "; "), F.when(F.col("more") > 0, F.concat(F.lit("; "), F.col("more").cast("string"), F.lit(" more"))).otherwise(""))
    return _lines(rows, line, F.struct("branch", "name"), "00-meta/tree.md", "# Knowledge tree\n\n")


def causal_map(nodes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """A Mermaid diagram of the ``most`` strongest edges; causal ones are thick, strong ones plain, weak ones dotted."""
    strongest = graph.edge_class(edges).orderBy(F.desc("base_score"), "id").limit(most)
    names = nodes.select("id", "title")
    rows = strongest.select("source_id", "target_id", "base_score", "class", F.col("id").alias("eid")).join(names.withColumnsRenamed({"id": "source_id", "title": "a"}), "source_id").join(names.withColumnsRenamed({"id": "target_id", "title": "b"}), "target_id")
    arrow = F.when(F.col("class") == "causal", " ==> ").when(F.col("class") == "strong", " --> ").otherwise(" -.-> ")
    node = lambda i, t: F.concat(mermaid_id(F.col(i)), F.lit('["'), mermaid_label(F.col(t)), F.lit('"]'))
    line = F.concat(F.lit("  "), node("source_id", "a"), arrow, node("target_id", "b"))
    return _lines(rows, line, F.struct((-F.col("base_score")).alias("s"), "eid"), "00-meta/causal-map.md", "```mermaid\ngraph LR\n", F.lit("```\n"))


def graph_json(nodes: DataFrame, edges: DataFrame, log: DataFrame | None = None, last: int = 100) -> DataFrame:
    """(part, json): nodes, edges, the newest log rows and counts, a JSON object a row, so that the export stays a table at any size."""
    out = nodes.select(F.lit("node").alias("part"), F.to_json(F.struct(*nodes.columns)).alias("json")).union(edges.select(F.lit("edge"), F.to_json(F.struct(*edges.columns))))
    if log is not None:
        out = out.union(log.orderBy(F.desc("id")).limit(last).select(F.lit("evolution"), F.to_json(F.struct(*log.columns))))
    counts = graph.stats(nodes, edges)
    return out.union(counts.select(F.lit("stats"), F.to_json(F.struct(*counts.columns))))


def vault(nodes: DataFrame, edges: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """All notes of a run: (name, text)."""
    out = paper_notes(nodes, edges).union(index_note(nodes, edges)).union(near_note(nodes, edges)).union(causal_map(nodes, edges))
    return out.union(score_note(scored)) if scored is not None else out


def empty_vault(spark) -> DataFrame:
    rows = [("papers/index.md", "# Paper index\n\nNo papers.\n"), ("00-meta/scores.md", "# Dry scores\n\nNo papers.\n"), ("00-meta/causal-map.md", "```mermaid\ngraph LR\n```\n")]
    return spark.createDataFrame(rows, "name string, text string")


def write_notes(notes: DataFrame, path: str) -> None:
    """Notes as a table partitioned by folder; ``write_files`` makes one file a note."""
    notes.withColumn("folder", F.regexp_extract("name", "^(.*)/", 1)).write.mode("overwrite").partitionBy("folder").json(path)


def write_files(notes: DataFrame, path: str) -> None:
    """One file a note under ``path``, written by tasks: all of them or none (see ``sources.notes``)."""
    note_files.write(notes, path)


def plain_notes(papers: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """(name, text) of a note for each paper from its own row, and its dry score where there is one; no graph is needed."""
    rows = papers.join(scored.select("paper_id", "dry_score"), "paper_id", "left") if scored is not None else papers.withColumn("dry_score", F.lit(None).cast("double"))
    fields = {"id": quoted(F.col("paper_id").cast("string")), "title": quoted(F.col("title")), "year": F.coalesce(F.col("year"), F.lit(0)).cast("string"), "b1": F.when(F.col("dry_score").isNotNull(), F.format_string("%.4f", "dry_score")).otherwise("—")}
    body = F.concat(front_matter(fields), F.lit("\n# "), text_or_empty(F.col("title")), F.lit("\n\n"), text_or_empty(F.col("abstract")), F.lit("\n"))
    return rows.select(F.concat(F.lit("papers/"), file_name(F.col("paper_id").cast("string")), F.lit(".md")).alias("name"), body.alias("text"))
