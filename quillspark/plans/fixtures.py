"""The bundled test tables in the roles of the engine's own: papers, seeds, graphs, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NOW = 2026
QUERY = "thtion attion ertion of the"
INTENT, BACKGROUND = ("attion", "ertion", "thtion"), ("of", "the")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A small table on all cores: it may be one row group, which one task would read and score alone."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if 1 << 20 < size < most else rows


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: the first line, cut, is the title; years and citations come from the id."""
    d = dealt(table(spark, sf_dir, "documents"))
    return d.select(
        F.col("doc_id").alias("paper_id"), F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"), F.col("text").alias("abstract"), (2015 + F.col("doc_id") % 12).cast("int").alias("year"),
        (F.col("doc_id") * 37 % 131).cast("int").alias("citations"), "source", "lang", F.col("doc_id").alias("pos"), F.lit("").alias("venue"),
    )


def token_ranks(spark: SparkSession, sf_dir: str, most: int = 200) -> DataFrame:
    """(rank, token): ASCII tokens of six letters or more by the number of documents that have them."""
    from ..functions.text import tokens

    each = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.explode(F.array_distinct(F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 6))).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(most)
    return counts.select(F.row_number().over(W.orderBy(F.desc("n"), "token")).alias("rank"), "token")


def seeds(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """n seeds from the corpus: the k-th has the k-th token as name, those n and 2n further as aliases, and every n-th as keyword."""
    t = token_ranks(spark, sf_dir, n * 8)
    rows = t.select(((F.col("rank") - 1) % n + 1).alias("k"), F.floor((F.col("rank") - 1) / n).alias("j"), "token")
    s = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("j", "token"))).alias("t"))
    w = F.transform("t", lambda x: x["token"])
    return s.select(
        F.concat(F.lit("method-"), F.col("k").cast("string")).alias("node_id"), F.get(w, 0).alias("name"), (F.col("k") % 5).cast("int").alias("level"), F.lit("method").alias("category"), F.lit("").alias("description"),
        F.slice(w, 2, 2).alias("aliases"), w.alias("keywords"), F.col("k").cast("int").alias("seed_pos"),
    )


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): regions, nations and customers as nodes, each under its parent, orders as edges from customer to nation."""
    c, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    node = lambda prefix, key, kind, title, level: [F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(title).alias("title"), F.array(F.lit(level)).alias("knowledge_level")]
    nodes = r.select(*node("r-", "r_regionkey", "seed", "r_name", "L1-region")).union(n.select(*node("n-", "n_nationkey", "seed", "n_name", "L2-nation"))).union(c.select(*node("c-", "c_custkey", "paper", "c_name", "L3-customer")))
    home = c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    edges = o.join(home, "o_custkey").select(
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("n-"), F.col("c_nationkey").cast("string")).alias("target_id"),
        F.when(F.col("o_orderstatus") == "F", "causation").otherwise("correlation").alias("base_type"), (F.col("o_totalprice") / 600000.0).alias("base_score"),
        F.struct(
            ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0)).alias("is_causal"), F.array().cast("array<string>").alias("conditions_met"), F.lit(0.5).alias("confidence"), F.lit(None).cast("timestamp").alias("last_evaluated"),
            F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("temporal_precedence"), F.lit(True), F.lit("intervention_test"), F.col("o_orderkey") % 4 == 0)).otherwise(F.create_map().cast("map<string,boolean>")).alias("promotion_path"),
        ).alias("causal_promotion"),
        F.concat(F.lit("ordered "), F.col("o_orderpriority")).alias("mechanism_description"), F.col("o_orderkey").alias("seq"),
    )
    return nodes, edges
