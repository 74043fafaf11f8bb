"""Registered queries of the engine's operators over the bundled tables, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import replies
from ..functions import text as T
from ..operators import dedup, graph, ontology, render, reports, scoring, screening, seeds
from ..sources import landed, notes, readers
from ..sources.tables import shared_dir, stored
from ..sources.versions import Versions
from ..streaming import events as stream
from ..streaming.progress import Listener, Progress
from ..streaming.results import Results
from .fixtures import BACKGROUND, INTENT, NOW, QUERY, dealt, papers, table, trade_graph
from .fixtures import seeds as corpus_seeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_PAPERS = """papers AS (
  SELECT doc_id AS paper_id, left(split_part(text, chr(10), 1), 120) AS title, text AS abstract, (2015 + doc_id % 12)::INT AS year, (doc_id * 37 % 131)::INT AS citations, source, lang, doc_id AS pos FROM documents
)"""
_TOKENS = "list_transform(regexp_extract_all({0}, '[a-zA-Z0-9]+'), lambda x: lower(x))"


def _bm25_sql(terms: tuple[str, ...] = (*[t for t in QUERY.split()],)) -> str:
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{t}'))::DOUBLE AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE f{i} > 0)::DOUBLE AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN f{i} > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1.0) * f{i} * 2.5 / (f{i} + 1.5 * (0.5 + 0.5 * dl / avgdl)) ELSE 0.0 END" for i in range(len(terms)))
    return f"""{_PAPERS}, toks AS (
  SELECT *, {_TOKENS.format("title")} AS tt, {_TOKENS.format("abstract")} AS ta FROM papers
), joined AS (SELECT *, list_concat(tt, ta) AS toks FROM toks
), tf AS (SELECT *, len(toks)::DOUBLE AS dl, {tf} FROM joined
), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM tf
), bm AS (SELECT tf.*, {score} AS bm25 FROM tf, st)"""


def _dry_sql(factor: str = "1.0") -> str:
    title = " + ".join(f"list_contains(tt, '{w}')::INT" for w in INTENT)
    abstract = " + ".join(f"list_contains(ta, '{w}')::INT" for w in INTENT)
    back = " + ".join(f"(list_contains(tt, '{w}') OR list_contains(ta, '{w}'))::INT" for w in BACKGROUND)
    return f"""{_bm25_sql()}, parts AS (
  SELECT *, least(bm25 / 10.0, 1.0) AS b, least((({title}) * 3.0 + ({abstract}) * 1.5) / {len(INTENT) * 3.0}, 1.0) AS i, least(({back}) / {float(len(BACKGROUND))}, 1.0) * 0.2 AS bg,
    CASE WHEN {NOW} - year <= 0 THEN 0.15 WHEN {NOW} - year = 1 THEN 0.15 * 0.7 WHEN {NOW} - year = 2 THEN 0.15 * 0.4 ELSE 0.0 END::DOUBLE AS re,
    CASE WHEN citations >= 100 THEN 0.10 WHEN citations >= 50 THEN 0.10 * 0.7 WHEN citations >= 10 THEN 0.10 * 0.4 WHEN citations > 0 THEN 0.10 * 0.2 ELSE 0.0 END::DOUBLE AS im FROM bm
), dry AS (
  SELECT *, (b * 0.30::DOUBLE + i * 0.40::DOUBLE + bg * 0.10::DOUBLE + re * 0.10::DOUBLE + im * 0.10::DOUBLE) * {factor} AS raw FROM parts
)"""


def _dry(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return scoring.dry_score(papers(spark, sf_dir), QUERY, now=NOW, intent=INTENT, background=BACKGROUND, **options)


@query(f"WITH {_bm25_sql()} SELECT paper_id, round(bm25, 4) AS bm25 FROM bm")
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.bm25(papers(spark, sf_dir), QUERY).select("paper_id", F.round("bm25", 4).alias("bm25"))


@query(f"WITH {_dry_sql()} SELECT paper_id, round(raw, 4) AS dry_score, round(b, 4) AS bm25, round(i, 4) AS intent, round(bg, 4) AS bg_match, round(re, 4) AS recency, round(im, 4) AS impact, raw >= 0.25 AS passed FROM dry")
def dry_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dry(spark, sf_dir).select("paper_id", "dry_score", "dry_detail.*", "passed")


@query(f"WITH {_dry_sql()} SELECT paper_id, round(raw, 4) AS dry_score FROM dry WHERE raw >= 0.25")
def dry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dry(spark, sf_dir).where("passed").select("paper_id", "dry_score")


@query(f"WITH {_dry_sql()} SELECT paper_id, dry_score, row_number() OVER (ORDER BY dry_score DESC, pos)::INT AS rank FROM (SELECT *, round(raw, 4) AS dry_score FROM dry ORDER BY dry_score DESC, pos LIMIT 50)")
def dry_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = scoring.ranked(_dry(spark, sf_dir)).limit(50)
    return best.select("paper_id", "dry_score", F.row_number().over(W.orderBy(F.desc("dry_score"), "pos")).alias("rank"))


_REQUIRE, _EXCLUDE = ("ingen", "tionan"), ("heiten", "mente", "elleon")


def _found(words: tuple[str, ...]) -> str:
    return " + ".join(f"(contains(lower(title), '{w}') OR contains(lower(abstract), '{w}'))::INT" for w in words)


_FACTOR = f"""((CASE WHEN ({_found(_REQUIRE)}) = 0 THEN CASE WHEN ({_found(scoring.NEIGHBOURS)}) >= 2 THEN 0.7 ELSE 0.3 END ELSE 1.0 END::DOUBLE)
  * (CASE WHEN ({_found(_EXCLUDE)}) > 0 THEN greatest(0.1, 1.0 - ({_found(_EXCLUDE)}) * 0.15) ELSE 1.0 END::DOUBLE))"""


@query(f"WITH {_dry_sql(_FACTOR)} SELECT paper_id, round(raw, 7) AS dry_score, raw >= 0.25 AS passed FROM dry")
def domain_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    # seven places: the penalties make scores that lie on a border of four
    return _dry(spark, sf_dir, require=_REQUIRE, exclude=_EXCLUDE).select("paper_id", F.round("dry_raw", 7).alias("dry_score"), "passed")


_SUB_T = " + ".join(f"contains(lower(title), '{w}')::INT" for w in INTENT)
_SUB_A = " + ".join(f"contains(lower(abstract), '{w}')::INT" for w in INTENT)
_SUB_B = " + ".join(f"(contains(lower(title), '{w}') OR contains(lower(abstract), '{w}'))::INT" for w in BACKGROUND)


@query(f"""WITH {_bm25_sql()}, s AS (SELECT *, least(bm25 / 10.0, 1.0) AS v1, least(1.0, (({_SUB_T}) * 3.0 + ({_SUB_A}) * 1.5) / {len(INTENT) * 3.0}) AS v2, least(1.0, ({_SUB_B}) / {max(len(BACKGROUND) * 0.3, 1.0)}) AS v3,
    CASE WHEN year = 0 OR year > {NOW} THEN 0.5 WHEN {NOW} - year <= 5 THEN greatest(0.0, 1.0 - ({NOW} - year) / 5.0) ELSE 0.0 END::DOUBLE AS v4,
    CASE WHEN citations >= 100 THEN 1.0 WHEN citations >= 10 THEN 0.5 WHEN citations >= 1 THEN 0.2 ELSE 0.0 END::DOUBLE AS v5,
    least(1.0, citations / 2 / 50.0) AS v6 FROM bm)
SELECT paper_id, round((v1 * 0.30 + v2 * 0.40 + v3 * 0.10 + v4 * 0.10 + v5 * 0.10 + v6 * 0.05) / 1.05, 4) AS composite FROM s""")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scorer = scoring.Composite.default(QUERY, now=NOW, extra=("author",))
    return scorer.score(papers(spark, sf_dir)).select("paper_id", F.round("composite", 4).alias("composite"))


_CORE, _ALWAYS, _ALONE = ("tion", "ing", "the ", "and", "elle", "ment", "eich"), ("oningthe", "zukeit"), ("ened", "aux")


def _hit_sql(column: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({column}, '{w}')::INT" for w in words) + ")"


@query(f"""WITH {_PAPERS}, h AS (SELECT *, lower(title) AS t, lower(title || ' ' || abstract) AS w FROM papers
), k AS (SELECT *, {_hit_sql("w", _CORE)} AS core_hits FROM h WHERE {_hit_sql("w", _ALWAYS)} = 0
), f AS (SELECT * FROM k WHERE NOT ({_hit_sql("t", _ALONE)} > 0 AND core_hits < 2) AND core_hits >= 1)
SELECT paper_id, core_hits::INT AS core_hits FROM f WHERE core_hits >= CASE WHEN (SELECT count(*) FROM f WHERE core_hits >= 2) >= 5 THEN 2 ELSE 1 END""")
def keyword_filter_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.keyword_filter(papers(spark, sf_dir), core=_CORE, always=_ALWAYS, alone=_ALONE).select("paper_id", "core_hits")


@query(f"WITH {_PAPERS} SELECT paper_id, citations, year FROM papers WHERE year BETWEEN 2018 AND 2024 ORDER BY citations DESC, year DESC, pos LIMIT 50")
def year_filter_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.top(screening.years(papers(spark, sf_dir), 2018, 2024), 50, "citations", "year").select("paper_id", "citations", "year")


@query(f"""WITH {_PAPERS}, a AS (
  SELECT *, 0 AS s, 'narrow' AS strategy FROM papers WHERE lang = 'xx' UNION ALL SELECT *, 1, 'one source' FROM papers WHERE source = 'src3' AND year < 2015
  UNION ALL SELECT *, 2, 'wide' FROM papers WHERE lang = 'fr'
), k AS (SELECT * FROM a WHERE year >= 2018) SELECT paper_id, strategy FROM k WHERE s = (SELECT min(s) FROM k)""")
def ladder_first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = [("narrow", F.col("lang") == "xx"), ("one source", (F.col("source") == "src3") & (F.col("year") < 2015)), ("wide", F.col("lang") == "fr")]
    return screening.ladder(papers(spark, sf_dir), tries, F.col("year") >= 2018).select("paper_id", "strategy")


@query(f"""WITH {_dry_sql()}, s AS (SELECT d.*, round(raw, 4) AS dry_score, raw >= 0.25 AS passed, CASE WHEN l.doc_id IS NOT NULL THEN 2.0 + l.quality + l.toxic END AS mean_score FROM dry d LEFT JOIN labels l ON d.paper_id = l.doc_id
), t AS (SELECT *, CASE WHEN mean_score >= 3.0 THEN 0 WHEN mean_score IS NOT NULL THEN 1 WHEN passed THEN 2 ELSE 3 END AS tier FROM s)
SELECT paper_id, tier::INT AS tier FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def core_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), (2.0 + F.col("quality") + F.col("toxic")).alias("mean_score"), F.lit(False).alias("llm_passed"))
    return screening.core_papers(_dry(spark, sf_dir).join(reviewed, "paper_id", "left")).select("paper_id", "tier")


@query(f"""WITH {_dry_sql()}, r AS (SELECT d.*, l.quality * 4 AS relevance FROM dry d JOIN labels l ON d.paper_id = l.doc_id)
SELECT paper_id, relevance::INT AS relevance FROM r WHERE relevance >= 3 ORDER BY relevance DESC, pos LIMIT 20""")
def relevance_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), (F.col("quality") * 4).cast("int").alias("relevance"))
    return screening.keep_relevant(papers(spark, sf_dir).join(said, "paper_id"), 20).select("paper_id", "relevance")


_SEEDS = f"""ranked AS (
  SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS rank FROM (SELECT DISTINCT doc_id, unnest({_TOKENS.format("text")}) AS token FROM documents) WHERE length(token) >= 6 GROUP BY token
), seeds AS (
  SELECT ((rank - 1) % 20 + 1)::INT AS seed_pos, list(token ORDER BY rank) AS keywords FROM ranked WHERE rank <= 160 GROUP BY 1
)"""
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_MATCH = f"""WITH {_PAPERS}, {_SEEDS}, p AS (
  SELECT paper_id, lower(title) AS t, lower(title || ' ' || abstract) AS x,
    list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || abstract), '[a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))) AS w FROM papers
), s AS (
  SELECT p.paper_id, 'method-' || seed_pos AS node_id, seed_pos, seed_pos % 5 AS level,
    least(1.0, (len(list_intersect(w, keywords)) / (len(w) + len(keywords) - len(list_intersect(w, keywords))))
      + list_sum(list_transform(keywords[1:3], lambda k: CASE WHEN contains(x, k) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END))
      + list_sum(list_transform(keywords[1:3], lambda k: CASE WHEN contains(t, k) THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END))) AS score
  FROM p, seeds
), m AS (
  SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY round(score, 9) DESC, seed_pos)::INT AS rank FROM s WHERE score >= 0.15
)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.match_rows(papers(spark, sf_dir), corpus_seeds(spark, sf_dir))


@query(f"{_MATCH} SELECT paper_id, node_id, round(score, 3) AS score FROM m WHERE rank <= 5")
def seed_match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.match(papers(spark, sf_dir), corpus_seeds(spark, sf_dir)).select("paper_id", "node_id", F.round("score", 3).alias("score"))


@query(f"{_MATCH} SELECT 'edge::' || paper_id || '::' || node_id AS id, paper_id::VARCHAR AS source_id, node_id AS target_id, round(score, 3) AS base_score FROM m WHERE rank <= 5")
def seed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.edges(_matches(spark, sf_dir))


@query(f"{_MATCH} SELECT p.paper_id, coalesce(len(list_distinct(list(m.level) FILTER (WHERE m.rank <= 5))), 0)::INT AS n_levels, count(m.node_id)::INT AS n_seeds, round(coalesce(avg(m.score), 0.0), 3) AS confidence FROM papers p LEFT JOIN m ON p.paper_id = m.paper_id AND m.rank <= 5 GROUP BY p.paper_id")
def seed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matches(spark, sf_dir)
    return m.select("paper_id", F.size("knowledge_level").alias("n_levels"), F.size("matched_seeds").alias("n_seeds"), F.col("knowledge_level_confidence").alias("confidence"))


@query(f"""{_MATCH} SELECT node_id AS seed_id, count(*)::BIGINT AS n_papers, row_number() OVER (ORDER BY count(*) DESC, node_id)::INT AS rank FROM m WHERE rank <= 5 GROUP BY node_id""")
def near_transfer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.near_transfer(seeds.edges(_matches(spark, sf_dir)), papers(spark, sf_dir)).select("seed_id", "n_papers", "rank")


@query("""WITH t AS (SELECT d.doc_id, l.quality::VARCHAR AS domain, unnest([struct_pack(kind := 'pattern', value := 'pattern ' || d.lang), struct_pack(kind := 'math_core', value := d.source || d.lang), struct_pack(kind := 'architecture', value := d.source)]) AS s FROM documents d JOIN labels l USING (doc_id))
SELECT s.kind AS kind, s.value AS value, count(*)::BIGINT AS n_papers, count(DISTINCT domain)::BIGINT AS n_domains FROM t WHERE length(s.value) > CASE WHEN s.kind = 'pattern' THEN 5 ELSE 3 END GROUP BY 1, 2 HAVING count(*) >= 2""")
def far_transfer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return reports.far_transfer(rows, pattern=F.concat(F.lit("pattern "), "lang"), core=F.concat("source", "lang"), architecture=F.col("source"), domain=F.col("quality").cast("string"), id="doc_id")


@query(f"""WITH {_dry_sql()}, k AS (SELECT paper_id, round(raw, 4) AS s, row_number() OVER (ORDER BY round(raw, 4) DESC, pos) AS rn FROM dry WHERE round(raw, 4) > 0.2)
SELECT a.paper_id::VARCHAR AS source_id, b.paper_id::VARCHAR AS target_id, b.s AS base_score FROM k a JOIN k b ON a.rn < b.rn""")
def pair_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pairs(_dry(spark, sf_dir)).select("source_id", "target_id", "base_score")


@query(f"""WITH {_dry_sql()}, s AS (SELECT d.paper_id::VARCHAR AS paper_id, title, CASE WHEN round(raw, 4) > 0 THEN round(raw, 4) ELSE 0.0 END AS b1, coalesce((1.0 + l.quality + l.toxic) / 5.0, 0.0)::DOUBLE AS b2 FROM dry d LEFT JOIN labels l ON d.paper_id = l.doc_id)
SELECT paper_id, b1, b2, row_number() OVER (ORDER BY b2 DESC, b1 DESC, title, paper_id)::BIGINT AS rank FROM s""")
def score_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), (1.0 + F.col("quality") + F.col("toxic")).alias("mean_score"))
    p = papers(spark, sf_dir)
    nodes, edges = graph.build(p, _dry(spark, sf_dir), said, paired=False)  # an index of scores reads score edges only
    return graph.score_index(nodes, edges).select("paper_id", "b1", "b2", "rank")


@query(f"""WITH {_dry_sql()}, s AS (SELECT round(raw, 4) AS s FROM dry), c AS (
  SELECT CASE WHEN s < 0.2 THEN '0.0-0.2' WHEN s < 0.3 THEN '0.2-0.3' WHEN s < 0.4 THEN '0.3-0.4' WHEN s < 0.5 THEN '0.4-0.5' WHEN s < 0.6 THEN '0.5-0.6' WHEN s < 0.7 THEN '0.6-0.7' ELSE '0.7-1.0' END AS bin, count(*) AS n FROM s GROUP BY 1)
SELECT b.bin, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (SELECT count(*) FROM s) * 100, 1) AS percent FROM (SELECT unnest(['0.0-0.2', '0.2-0.3', '0.3-0.4', '0.4-0.5', '0.5-0.6', '0.6-0.7', '0.7-1.0']) AS bin) b LEFT JOIN c USING (bin)""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(_dry(spark, sf_dir)).select("bin", "n", "percent")


@query(f"""WITH {_dry_sql()}, s AS (SELECT round(raw, 4) AS s, raw >= 0.25 AS passed FROM dry)
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE passed)::BIGINT AS passed, round(count(*) FILTER (WHERE passed) / count(*), 6) AS pass_rate, round(avg(s), 6) AS mean_score, round((SELECT avg(s) FROM (SELECT s FROM s ORDER BY s DESC LIMIT 3)), 6) AS top3_mean FROM s""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(_dry(spark, sf_dir)).select("total", "passed", *[F.round(c, 6).alias(c) for c in ("pass_rate", "mean_score", "top3_mean")])


@query(f"""WITH {_dry_sql()}, s AS (SELECT *, round(raw, 4) AS dry_score, raw >= 0.25 AS passed FROM dry), k AS (SELECT paper_id, passed, row_number() OVER (PARTITION BY passed ORDER BY dry_score DESC, pos)::INT AS place FROM s)
SELECT paper_id, passed, CASE WHEN NOT passed THEN place END AS place FROM k WHERE passed OR place <= 10""")
def passed_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.passed_and_below(_dry(spark, sf_dir)).select("paper_id", "passed", "place")


@query(f"WITH {_PAPERS} SELECT year, count(*)::BIGINT AS n FROM papers GROUP BY year")
def year_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_year(papers(spark, sf_dir))


@query("WITH k AS (SELECT unnest([lang, source, 'year-' || doc_id % 12]) AS keyword FROM documents) SELECT keyword, count(*)::BIGINT AS n FROM k GROUP BY keyword ORDER BY n DESC, keyword LIMIT 8")
def keyword_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array("lang", "source", F.concat(F.lit("year-"), (F.col("doc_id") % 12).cast("string")))
    return reports.keyword_counts(table(spark, sf_dir, "documents"), keywords=words)


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), e AS (SELECT unnest(['src0', 'src1', 'absent']) AS source)
SELECT source, coalesce(n, 0)::BIGINT AS n, CASE WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'empty' END AS status FROM e FULL JOIN c USING (source)""")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.source_counts(papers(spark, sf_dir), ["src0", "src1", "absent"])


@query("""WITH k AS (SELECT doc_id, md5(lower(trim(text))) AS doi, CASE WHEN doc_id % 7 = 0 THEN (2000 + doc_id % 50)::VARCHAR || '.' || lpad((doc_id % 90)::VARCHAR, 5, '0') ELSE '' END AS arxiv FROM documents
), d AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY doc_id) AS n FROM k), e AS (SELECT *, row_number() OVER (PARTITION BY arxiv ORDER BY doc_id) AS m FROM d WHERE n = 1)
SELECT doc_id AS paper_id FROM e WHERE m = 1 OR arxiv = ''""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    arxiv = F.when(d % 7 == 0, F.concat((2000 + d % 50).cast("string"), F.lit("."), F.lpad((d % 90).cast("string"), 5, "0"), F.lit("v2"))).otherwise("")
    rows = table(spark, sf_dir, "documents").select(d.alias("paper_id"), F.md5(F.lower(F.trim("text"))).alias("doi"), arxiv.alias("arxiv_id"), d.alias("pos"))
    return dedup.exact(rows).select("paper_id")


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).withColumns({"doi": F.lit(""), "arxiv_id": F.lit("")})


#: The ratio of matching blocks of every two titles that a distance leaves: the longest match, then what is left and right of it, again and again.
_TITLES = f"""RECURSIVE {_PAPERS}, titles AS (SELECT lower(trim(title)) AS t, min(pos) AS p FROM papers WHERE lower(trim(title)) <> '' GROUP BY 1
), later AS (SELECT a.t AS a, b.t AS b, a.p AS ap, b.p AS bp FROM titles a JOIN titles b ON a.p > b.p AND least(length(a.t), length(b.t)) >= greatest(length(a.t), length(b.t)) * 0.7391
  WHERE levenshtein(a.t, b.t) <= 0.15 * (length(a.t) + length(b.t)) + strlen(a.t) - length(a.t) + strlen(b.t) - length(b.t) + 1e-9
), near AS MATERIALIZED (SELECT row_number() OVER () AS id, *, length(a) AS la, length(b) AS lb FROM (SELECT * FROM later UNION ALL SELECT b, a, bp, ap FROM later)
), cells AS MATERIALIZED (SELECT id, i, j, max(i) OVER (PARTITION BY id, i - j, i - n) - i + 1 AS f FROM (
  SELECT id, i, j, row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS n FROM (SELECT id, b, lb, unnest(range(1, la + 1)) AS i, unnest(string_split(a, '')) AS x FROM near) JOIN (SELECT id, unnest(range(1, lb + 1)) AS j, unnest(string_split(b, '')) AS y FROM near) USING (id) WHERE x = y)
), blocks AS (SELECT id, 1::BIGINT AS alo, la + 1 AS ahi, 1::BIGINT AS blo, lb + 1 AS bhi, 0::BIGINT AS k FROM near UNION ALL
  SELECT id, u.alo, u.ahi, u.blo, u.bhi, u.k FROM (SELECT id, unnest([{{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j, 'k': k}}, {{'alo': i + k, 'ahi': ahi, 'blo': j + k, 'bhi': bhi, 'k': 0}}]) AS u FROM (
    SELECT *, m // 1000000 + 1 AS k, 1000 - (m % 1000000) // 1000 AS i, 1000 - m % 1000 AS j FROM (
      SELECT r.id, alo, ahi, blo, bhi, max((least(f, ahi - i, bhi - j) - 1) * 1000000 + (1000 - i) * 1000 + 1000 - j)::BIGINT AS m FROM blocks r JOIN cells c ON c.id = r.id AND i >= alo AND i < ahi AND j >= blo AND j < bhi GROUP BY r.id, alo, ahi, blo, bhi)))
), ratios AS (SELECT a, b, ap, bp, 2.0 * m / (la + lb) AS ratio FROM near JOIN (SELECT id, sum(k)::BIGINT AS m FROM blocks GROUP BY id) USING (id))"""


@query(f"WITH {_TITLES} SELECT a AS new_title, b AS old_title, round(ratio, 6) AS ratio FROM ratios WHERE ap > bp AND ratio >= 0.85")
def fuzzy_dedup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.similar_titles(_titled(spark, sf_dir)).select("new_title", "old_title", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {_TITLES}, turned AS (SELECT ap AS t, list(bp) AS them FROM ratios WHERE ratio >= 0.85 GROUP BY ap
), line AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) AS step, paper_id, length(coalesce(abstract, '')) AS n, titles.p AS t, list_append(coalesce(them, []), titles.p) AS near FROM papers LEFT JOIN titles ON titles.t = lower(trim(title)) LEFT JOIN turned ON turned.t = titles.p
), run AS (SELECT 0::BIGINT AS step, []::STRUCT(id BIGINT, t BIGINT, n BIGINT)[] AS kept UNION ALL
  SELECT step, CASE WHEN met = 0 THEN list_append(kept, own) WHEN own.n > kept[met].n THEN kept[: met - 1] || [own] || kept[met + 1 :] ELSE kept END FROM (
    SELECT l.step, r.kept, {{'id': l.paper_id, 't': l.t, 'n': l.n}} AS own, coalesce(list_position(list_transform(r.kept, lambda x: list_contains(l.near, x.t)), true), 0) AS met FROM run r JOIN line l ON l.step = r.step + 1)
) SELECT k.id AS paper_id, title FROM (SELECT unnest(kept) AS k FROM (SELECT kept FROM run ORDER BY step DESC LIMIT 1)) JOIN papers ON paper_id = k.id""")
def fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.whole(_titled(spark, sf_dir)).select("paper_id", "title")


_GRAPH = """nodes AS (
  SELECT 'r-' || r_regionkey AS id, 'seed' AS type, r_name AS title, 'L1-region' AS level FROM region UNION ALL SELECT 'n-' || n_nationkey, 'seed', n_name, 'L2-nation' FROM nation UNION ALL SELECT 'c-' || c_custkey, 'paper', c_name, 'L3-customer' FROM customer
), edges AS (
  SELECT 'o-' || o_orderkey AS id, 'c-' || o_custkey AS source_id, 'n-' || c_nationkey AS target_id, CASE WHEN o_orderstatus = 'F' THEN 'causation' ELSE 'correlation' END AS base_type, o_totalprice / 600000.0 AS base_score,
    o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS is_causal, CASE WHEN o_orderkey % 3 = 0 THEN true END AS temporal, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 = 0 END AS intervention, 'ordered ' || o_orderpriority AS why
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


@query(f"WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes)::BIGINT AS nodes, (SELECT count(*) FROM nodes WHERE type = 'paper')::BIGINT AS papers, count(*)::BIGINT AS edges, count(*) FILTER (WHERE base_type = 'causation' OR is_causal)::BIGINT AS causal_edges FROM edges")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(*trade_graph(spark, sf_dir))


@query(f"WITH {_GRAPH} SELECT id, base_score FROM edges WHERE base_type = 'causation' AND is_causal")
def causal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.causal(trade_graph(spark, sf_dir)[1]).select("id", "base_score")


@query(f"WITH {_GRAPH} SELECT CASE WHEN base_type = 'causation' OR is_causal THEN 'causal' WHEN base_score > 0.3 THEN 'strong' ELSE 'weak' END AS class, count(*)::BIGINT AS n FROM edges GROUP BY 1")
def edge_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_class(trade_graph(spark, sf_dir)[1]).groupBy("class").agg(F.count("*").alias("n"))


@query(f"WITH {_GRAPH}, i AS (SELECT source_id AS node_id, id FROM edges UNION ALL SELECT target_id, id FROM edges WHERE source_id <> target_id) SELECT node_id, count(*)::BIGINT AS n FROM i GROUP BY node_id")
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incident(trade_graph(spark, sf_dir)[1]).groupBy("node_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_GRAPH}, k AS (SELECT e.source_id AS node_id, e.target_id AS other_id, n.title, e.base_score, row_number() OVER (PARTITION BY e.source_id ORDER BY e.base_score DESC, e.id) AS r FROM edges e JOIN nodes n ON n.id = e.target_id WHERE n.type = 'seed')
SELECT node_id, other_id, title, base_score FROM k WHERE r <= 15""")
def top_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    return graph.neighbours(edges, nodes, "seed", 15)


@query(f"""WITH {_GRAPH}, c AS (SELECT *, coalesce(temporal, false)::INT AS a, (length(trim(why)) > 20)::INT AS b, coalesce(intervention, false)::INT AS d FROM edges)
SELECT id, CASE WHEN is_causal THEN 'already_causal' WHEN a + b + d >= 2 THEN 'ready' ELSE 'not_ready' END AS status, CASE WHEN is_causal THEN 0 ELSE a + b + d END::INT AS n_met, CASE WHEN is_causal THEN 0.5 ELSE (a + b + d) / 4.0 END::DOUBLE AS confidence FROM c""")
def promotion_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.promotion_check(trade_graph(spark, sf_dir)[1]).select("id", "promotion.status", F.size("promotion.met").alias("n_met"), "promotion.confidence")


@query(f"""WITH {_GRAPH}, m AS (SELECT 'n-' || (2 * k) AS a, 'n-' || (2 * k + 1) AS b FROM range(12) t(k)), e AS (
  SELECT coalesce(ms.a, source_id) AS s, coalesce(mt.a, target_id) AS t, base_score FROM edges LEFT JOIN m ms ON source_id = ms.b LEFT JOIN m mt ON target_id = mt.b WHERE ms.a IS NOT NULL OR mt.a IS NOT NULL
), x AS (SELECT s AS source_id, t AS target_id, max(base_score) AS base_score FROM e WHERE s <> t GROUP BY 1, 2)
SELECT source_id, target_id, base_score FROM x WHERE NOT EXISTS (SELECT 1 FROM edges o WHERE o.source_id = x.source_id AND o.target_id = x.target_id)""")
def merge_rewire(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    k = spark.range(12)
    pairs = k.select(F.concat(F.lit("n-"), (F.col("id") * 2).cast("string")).alias("a"), F.concat(F.lit("n-"), (F.col("id") * 2 + 1).cast("string")).alias("b"))
    _, after = ontology.merge(nodes, edges, pairs)
    return after.where(F.startswith("id", F.lit("edge::"))).select("source_id", "target_id", "base_score")


@query(f"""WITH {_GRAPH}, up AS (SELECT id, 'renamed' AS title FROM nodes WHERE type = 'seed' UNION ALL SELECT 'n-new', 'added')
SELECT id, title FROM nodes WHERE id NOT IN (SELECT id FROM up) UNION ALL SELECT id, title FROM up""")
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trade_graph(spark, sf_dir)[0].withColumn("seq", F.lit(0))
    new = nodes.where("type = 'seed'").withColumns({"title": F.lit("renamed"), "seq": F.lit(2)}).unionByName(nodes.where("type = 'seed'").withColumns({"title": F.lit("older"), "seq": F.lit(1)}))
    added = spark.createDataFrame([("n-new", "seed", "added", ["L2-nation"], 3)], nodes.schema)
    return graph.upsert(nodes, new.unionByName(added)).select("id", "title")


@query("""WITH w AS (SELECT p_partkey::VARCHAR AS id, p_brand AS level, list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9_]{2,}'))) AS w FROM part)
SELECT x.level, x.id AS a, y.id AS b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 3) AS similarity FROM w x JOIN w y ON x.level = y.level AND x.id < y.id WHERE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.7""")
def sibling_merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.array("p_brand").alias("knowledge_level"))
    return ontology.sibling_pairs(nodes)


@query("""WITH RECURSIVE n AS (SELECT p_partkey::VARCHAR AS id, unnest([p_brand, 'size-' || p_size]) AS level, list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9_]{2,}'))) AS w FROM part
), j AS (SELECT x.level, x.id AS a, y.id AS b, len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) AS s FROM n x JOIN n y ON x.level = y.level AND x.id < y.id
), p AS MATERIALIZED (SELECT level, a, b, round(s, 3) AS similarity, row_number() OVER (ORDER BY level, a, b) AS k FROM j WHERE s >= 0.5
), g AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS level, ''::VARCHAR AS a, ''::VARCHAR AS b, 0.0::DOUBLE AS similarity, false AS won, []::VARCHAR[] AS taken
UNION ALL SELECT p.k, p.level, p.a, p.b, p.similarity, NOT list_has_any(g.taken, [p.a, p.b]), CASE WHEN list_has_any(g.taken, [p.a, p.b]) THEN g.taken ELSE list_concat(g.taken, [p.a, p.b]) END FROM g JOIN p ON p.k = g.k + 1
) SELECT level, a, b, similarity FROM g WHERE won""")
def sibling_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand and, those left, by size, each merged with one sibling at most."""
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.array("p_brand", F.concat(F.lit("size-"), F.col("p_size").cast("string"))).alias("knowledge_level"))
    return ontology.sibling_merges(nodes, 0.5)


@query("""WITH n AS (SELECT 'L' || p_size AS level, count(*) AS n FROM part GROUP BY 1)
SELECT level, n::BIGINT AS n, 'L' || (substr(level, 2)::INT - 1) AS parent_level FROM n WHERE n.n < (SELECT count(*) // 50 FROM part) AND substr(level, 2)::INT > 1 AND 'L' || (substr(level, 2)::INT - 1) IN (SELECT level FROM n)""")
def level_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return ontology.collapses(parts.select(F.array(F.concat(F.lit("L"), F.col("p_size").cast("string"))).alias("knowledge_level")), parts.count() // 50)


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events), r AS (SELECT *, min((event_type IN ('view', 'click'))::INT) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM e WHERE n <= 5)
SELECT user_id, sum(run)::BIGINT AS consecutive FROM r GROUP BY user_id""")
def consecutive_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology.consecutive_triggers(table(spark, sf_dir, "events"), by=["user_id"], seq="event_id", action="event_type", triggers=("view", "click"))


_CONFLICT = """r AS (SELECT l.doc_id, (l.doc_id % 23)::INT AS n, (l.doc_id % 3)::INT AS run, (l.doc_id % 11) / 10.0::DOUBLE AS score, (l.quality + l.toxic + l.doc_id % 3)::INT AS conditions, CASE l.doc_id % 4 WHEN 0 THEN ['merge', 'split'] WHEN 1 THEN ['new_level'] WHEN 2 THEN ['reparent', 'other'] ELSE [] END AS changes FROM labels l
), i AS (SELECT *, coalesce(list_sum(list_transform(changes, lambda c: CASE c WHEN 'new_level' THEN least(3.0, n * 0.1) WHEN 'reparent' THEN 2.0 WHEN 'merge' THEN 2.0 WHEN 'split' THEN 3.0 ELSE 0.0 END::DOUBLE)), 0.0) AS total FROM r
), t AS (SELECT *, CASE WHEN n <= 1 OR total = 0 THEN 0.0 ELSE least(1.0, total / n) END AS impact FROM i)"""


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    changes = F.when(d % 4 == 0, F.array(F.lit("merge"), F.lit("split"))).when(d % 4 == 1, F.array(F.lit("new_level"))).when(d % 4 == 2, F.array(F.lit("reparent"), F.lit("other"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "labels").select(d, (d % 23).cast("int").alias("n"), (d % 3).cast("int").alias("run"), ((d % 11) / 10.0).alias("score"), (F.col("quality") + F.col("toxic") + d % 3).cast("int").alias("conditions"), changes.alias("changes"))
    return rows.withColumn("impact", ontology.impact(F.col("changes"), F.col("n")))


@query(f"WITH {_CONFLICT} SELECT doc_id, round(impact, 6) AS impact, CASE WHEN n < 10 THEN 'seed_anchored' WHEN run >= 2 THEN 'degraded_by_meta' WHEN score < 0.5 THEN 'single_loop' WHEN conditions < 2 THEN 'single_loop' WHEN impact > 0.3 THEN 'degraded_by_meta' ELSE 'double_loop' END AS action FROM t")
def impact_decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _conflicts(spark, sf_dir).select("doc_id", F.round("impact", 6).alias("impact"), ontology.decide(c("n"), c("run"), c("score"), c("conditions"), c("impact")).alias("action"))


@query(f"""WITH {_CONFLICT}, g AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'double_loop' WHEN 1 THEN 'seed_anchored' ELSE 'single_loop' END AS wanted FROM t)
SELECT doc_id, CASE WHEN wanted = 'single_loop' THEN 'recommended_action=single_loop' WHEN wanted = 'seed_anchored' THEN '' WHEN run >= 2 THEN 'consecutive_trigger_limit' WHEN conditions < 2 THEN 'insufficient_conditions' WHEN impact > 0.3 THEN 'impact_ratio_exceeded' ELSE '' END AS reason FROM g""")
def guarded_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    wanted = F.when(c("doc_id") % 3 == 0, "double_loop").when(c("doc_id") % 3 == 1, "seed_anchored").otherwise("single_loop")
    return _conflicts(spark, sf_dir).select("doc_id", ontology.guard(wanted, c("n"), c("run"), c("conditions"), c("impact"))["reason"].alias("reason"))


@query("""WITH r AS (SELECT conv_id, turn, (turn % 6)::INT AS k, (conv_id % 7)::INT AS s FROM conversations), t AS (
  SELECT *, CASE k WHEN 0 THEN '{"score": ' || s || ', "reason": "x"}' WHEN 1 THEN 'I think {"score": ' || s || '} fits' WHEN 2 THEN 'score: ' || s WHEN 3 THEN 'The relevance is ' || s WHEN 4 THEN 'maybe ' || s || ' or so' ELSE 'nothing' END AS x FROM r)
SELECT conv_id, turn, CASE WHEN k IN (0, 1) THEN s WHEN k IN (2, 3, 4) AND s BETWEEN 1 AND 5 THEN s END::INT AS score, CASE WHEN k = 0 THEN 1.0 WHEN k = 1 THEN 0.9 WHEN k IN (2, 3) AND s BETWEEN 1 AND 5 THEN 0.5 WHEN k = 4 AND s BETWEEN 1 AND 5 THEN 0.3 END::DOUBLE AS confidence FROM t""")
def relevance_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("turn") % 6, (F.col("conv_id") % 7).cast("string")
    said = F.when(k == 0, F.concat(F.lit('{"score": '), s, F.lit(', "reason": "x"}'))).when(k == 1, F.concat(F.lit('I think {"score": '), s, F.lit("} fits"))).when(k == 2, F.concat(F.lit("score: "), s)).when(k == 3, F.concat(F.lit("The relevance is "), s)).when(k == 4, F.concat(F.lit("maybe "), s, F.lit(" or so"))).otherwise("nothing")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", replies.relevance(said).alias("r")).select("conv_id", "turn", "r.score", "r.confidence")


@query("""WITH s AS (SELECT doc_id, 1 + quality * 3 AS a, 2 + toxic AS b, doc_id % 6 AS c FROM labels)
SELECT doc_id, round((a + b + CASE WHEN c > 0 THEN c ELSE 0 END) / (2 + (c > 0)::INT), 2) AS mean_score, round((a + b + CASE WHEN c > 0 THEN c ELSE 0 END) / (2 + (c > 0)::INT), 2) >= 3.0 AS passed FROM s""")
def score_mean_4cl(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = 1 + F.col("quality") * 3, 2 + F.col("toxic"), F.col("doc_id") % 6
    said = F.when(F.col("doc_id") % 2 == 0, F.format_string('{"scores": {"contribution": %d, "C2": "%d", "clarity": %d}}', a, b, c)).otherwise(F.format_string('{"C1": %d, "correctness": %d, "c3": "%d"}', a, b, c))
    rows = table(spark, sf_dir, "labels").select("doc_id", replies.mean_score(replies.review_scores(said)).alias("mean_score"))
    return rows.withColumn("passed", F.col("mean_score") >= 3.0)


_TEMPLATE = """t AS (SELECT doc_id, source AS arch, lower(text) AS pat, lang || ' core ' || source AS core, list_distinct([lang, source, (doc_id % 3)::VARCHAR]) AS chain FROM documents
), w AS (SELECT *, list_distinct(regexp_extract_all(pat, '[a-z0-9_]{1,}')) AS pw, list_distinct(regexp_extract_all(lower(core), '[a-z0-9_]{1,}')) AS cw FROM t)"""


def _jac(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))))"


@query(f"""WITH {_TEMPLATE}, p AS (SELECT x.doc_id, (x.arch = y.arch) AS same, x.pw AS xp, y.pw AS yp, x.cw AS xc, y.cw AS yc, x.chain AS xs, y.chain AS ys FROM w x JOIN w y ON y.doc_id = x.doc_id + 20)
SELECT doc_id, round(least(1.0, (CASE WHEN same THEN 0.35 ELSE 0.0 END::DOUBLE + CASE WHEN len(xp) > 0 AND len(yp) > 0 THEN 0.25 * {_jac("xp", "yp")} ELSE 0 END + 0.20 * {_jac("xc", "yc")} + 0.20 * {_jac("xs", "ys")})
  / (0.75 + CASE WHEN len(xp) > 0 AND len(yp) > 0 THEN 0.25 ELSE 0.0 END)), 6) AS similarity FROM p""")
def template_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.array("lang", "source", (F.col("doc_id") % 3).cast("string")).alias("signal_chain"), F.col("source").alias("control_architecture"), F.col("text").alias("abstract_pattern"), F.concat("lang", F.lit(" core "), "source").alias("mathematical_core")).alias("t"))
    d = stored(d.where("doc_id IS NOT NULL").select("doc_id", seeds.template(F.col("t")).alias("t")), "templates")  # each text is cut into words once
    other = d.select((F.col("doc_id") - 20).alias("doc_id"), F.col("t").alias("u"))
    return d.join(other, "doc_id").select("doc_id", F.round(seeds.parts_similarity(F.col("t"), F.col("u")), 6).alias("similarity"))


@query(f"""WITH {_PAPERS}, w AS (SELECT paper_id, list_distinct(list_transform(list_filter(string_split_regex(trim(title), '\\s+'), lambda x: length(x) > 3), lambda x: lower(x))) AS w, [1 + paper_id % 6] AS l FROM papers
), s AS (SELECT a.paper_id AS new_id, b.paper_id, 0.5 * (len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(list_concat(a.w, b.w))), 1)) + 0.5 * (1.0 - 0.15 * abs(a.l[1] - b.l[1])) AS r FROM w a, w b WHERE a.paper_id % 100 = 0 AND a.paper_id <> b.paper_id
), k AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY round(r, 9) DESC, paper_id)::INT AS rank FROM s) SELECT new_id, paper_id, round(r, 6) AS relevance, rank FROM k WHERE rank <= 15""")
def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir).withColumn("knowledge_level", F.array(F.concat(F.lit("L"), (1 + F.col("paper_id") % 6).cast("string"), F.lit("-x"))))
    found = seeds.retrieve(p.where("paper_id % 100 = 0"), p)
    return found.select("new_id", "paper_id", F.round("relevance", 6).alias("relevance"), "rank")


@query("""WITH r AS (SELECT page_id, 'https://doi.org/10.5555/AB.' || page_id AS doi, 'arXiv:' || (2000 + page_id % 20) || '.' || lpad((page_id * 7)::VARCHAR, 5, '0') || 'v3' AS aid, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, url FROM pages)
SELECT page_id::VARCHAR AS paper_id, trim(title) AS title, '10.5555/ab.' || page_id AS doi, regexp_extract(aid, '([0-9]{4}\\.[0-9]{4,5})', 1) AS arxiv_id, (1990 + page_id % 30)::INT AS year, url FROM r WHERE trim(title) <> ''""")
def source_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    raw = F.create_map(
        F.lit("paper_id"), p.cast("string"), F.lit("name"), F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1), F.lit("DOI"), F.concat(F.lit("https://doi.org/10.5555/AB."), p.cast("string")), F.lit("date"), F.concat(F.lit("Mon "), (1990 + p % 30).cast("string"), F.lit("-01-02")),
        F.lit("arxiv_id"), F.concat(F.lit("arXiv:"), (2000 + p % 20).cast("string"), F.lit("."), F.lpad((p * 7).cast("string"), 5, "0"), F.lit("v3")), F.lit("link"), F.col("url"),
    )
    rows = table(spark, sf_dir, "pages").select(raw.alias("raw"), p.alias("pos"))
    return readers.unified(rows, "pages").select("paper_id", "title", "doi", "arxiv_id", "year", "url")


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS w, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS all_w FROM documents)
SELECT doc_id, md5(string_agg(w, ' ' ORDER BY list_position(all_w, w))) AS abstract_md5 FROM w GROUP BY doc_id""")
def abstract_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    d = dealt(table(spark, sf_dir, "documents")).select("doc_id", words.alias("w")).where(F.size("w") > 0)
    index = readers.inverted_index(d, "doc_id", "w")
    return index.select("doc_id", F.md5(readers.rebuilt_abstract(F.col("i"))).alias("abstract_md5"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.tumbling(table(spark, sf_dir, "events"))
    return rows.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT 'user-' || user_id % 10 AS p, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS started, count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS ended, count(*) FILTER (WHERE event_type = 'click')::BIGINT AS scored, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors, sum(event_id % 9)::BIGINT AS tokens,
  CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'done_with_errors' ELSE 'done' END WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN 'running' ELSE 'pending' END AS status FROM events GROUP BY 1""")
def event_phase_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("view", "phase_start", "purchase", "phase_end", "click", "item_scored", "error", "error", "signup", "source_ok")])
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("t"), kind[F.col("event_type")].alias("e"), F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string")).alias("p"), F.create_map(F.lit("tokens_in"), (F.col("event_id") % 9).cast("string")).alias("rest"))
    return stream.counters(rows).select("p", "started", "ended", "scored", "errors", "tokens", "status")


@query(f"""WITH {_PAPERS}, w AS (SELECT paper_id, list_filter(string_split(lower(left(title, 60)), ' '), lambda x: length(x) > 2 AND NOT list_contains([{", ".join(f"'{w}'" for w in T.TITLE_STOP_WORDS)}], x)) AS w, title FROM papers)
SELECT paper_id, CASE WHEN len(w) > 0 THEN array_to_string(w[1:2], ' ') ELSE split_part(left(title, 60), ' ', 1) END AS terms FROM w""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("paper_id", T.search_terms(F.col("title")).alias("terms"))


@query("""WITH k AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) SELECT event_id, user_id, event_type FROM k WHERE n = 1""")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.first_rows(table(spark, sf_dir, "events"), "user_id", "event_type", pos="event_id").select("event_id", "user_id", "event_type")


@query("SELECT doc_id, length(text) // 4 + 150 AS tokens_in, (length(text) // 4 * 12) // 10 AS tokens_out, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:80] AS slug FROM documents")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = T.token_estimate(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", a.alias("tokens_in"), b.alias("tokens_out"), T.slug(F.col("text")).alias("slug"))


@query("SELECT doc_id AS paper_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.unread(papers(spark, sf_dir), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "paper_id")).select("paper_id")


@query("""WITH l AS (SELECT doc_id AS paper_id, max(quality * 40 + toxic)::INT AS citations FROM labels GROUP BY 1)
SELECT d.doc_id AS paper_id, CASE WHEN coalesce(nullif(l.citations, 0), d.doc_id * 37 % 131) >= 100 THEN 1.0 WHEN coalesce(nullif(l.citations, 0), d.doc_id * 37 % 131) >= 10 THEN 0.5 WHEN coalesce(nullif(l.citations, 0), d.doc_id * 37 % 131) >= 1 THEN 0.2 ELSE 0.0 END::DOUBLE AS composite FROM documents d LEFT JOIN l ON d.doc_id = l.paper_id""")
def enrichment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), (F.col("quality") * 40 + F.col("toxic")).cast("int").alias("citations"))
    scorer = scoring.Composite(scoring.Context(QUERY, INTENT, BACKGROUND, NOW)).add_source(known).add_scorer("impact", 1.0)
    return scorer.score(papers(spark, sf_dir)).select("paper_id", "composite")


@query(f"""WITH {_GRAPH}, a AS (SELECT *, CASE WHEN is_causal THEN 'already causal' WHEN base_score < 0.2 THEN 'no valid condition' END AS error FROM edges)
SELECT id, CASE WHEN error IS NULL THEN 'causation' ELSE base_type END AS base_type, error, CASE WHEN error IS NULL THEN 0.25 ELSE 0.5 END::DOUBLE AS confidence FROM a""")
def promote_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade_graph(spark, sf_dir)[1].withColumn("history", F.array().cast("array<struct<action: string, timestamp: timestamp, details: map<string, string>>>"))
    asked = edges.select("id", F.array(F.when(F.col("base_score") < 0.2, "nonsense").otherwise("intervention_test")).alias("conditions"), F.lit(None).cast("double").alias("confidence"))
    return graph.promote(edges, asked, F.lit("2026-01-01")).select("id", "base_type", "error", "causal_promotion.confidence")


@query(f"WITH {_GRAPH} SELECT id, CASE WHEN is_causal THEN 'correlation' ELSE base_type END AS base_type, CASE WHEN NOT is_causal THEN 'not causal' END AS error FROM edges")
def downgrade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade_graph(spark, sf_dir)[1].withColumn("history", F.array().cast("array<struct<action: string, timestamp: timestamp, details: map<string, string>>>"))
    return graph.downgrade(edges, edges.select("id", F.lit("checked").alias("reason")), F.lit("2026-01-01")).select("id", "base_type", "error")


@query("""WITH n AS (SELECT 'n-' || n_nationkey AS id, n_name AS title FROM nation) SELECT id, title || ' (split)' AS title FROM n UNION ALL SELECT id || '-' || i, 'part ' || i FROM n, range(1, 4) t(i)""")
def split_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    nodes = nodes.where(F.startswith("id", F.lit("n-"))).withColumn("seq", F.lit(0).cast("long"))
    cuts = nodes.select("id", F.array(*[F.lit(f"part {i}") for i in (1, 2, 3)]).alias("children"))
    return ontology.split(nodes, edges, cuts)[0].select("id", "title")


@query(f"""WITH {_GRAPH} SELECT 'edge::' || source_id || '::' || r.id AS id, source_id AS node, r.id AS parent, list_sort(list(DISTINCT target_id)) AS beside
FROM edges e, (SELECT id FROM nodes WHERE title = 'EUROPE') r GROUP BY source_id, r.id""")
def reparent_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every customer with orders moves under one region, beside the nations that its orders link it to
    nodes, edges = trade_graph(spark, sf_dir)
    moves = edges.select(F.col("source_id").alias("node"), F.lit("EUROPE").alias("parent")).distinct()
    after, log = ontology.reparent(nodes, edges, moves)
    noted = log.select(F.regexp_extract("description", "moved (\\S+) to (\\S+) beside (.*)", 1).alias("node"), F.regexp_extract("description", "beside (.*)", 1).alias("_b"))
    new = after.where(F.startswith("id", F.lit("edge::"))).select("id", F.col("source_id").alias("node"), F.col("target_id").alias("parent"))
    return new.join(noted, "node").select("id", "node", "parent", F.split("_b", ",").alias("beside"))


@query(f"WITH {_PAPERS}, m AS (SELECT 'years' AS branch, year::VARCHAR AS name FROM papers UNION ALL SELECT 'levels', 'L' || paper_id % 4 FROM papers) SELECT branch, name, count(*)::BIGINT AS n, greatest(0, count(*) - 8)::BIGINT AS more FROM m GROUP BY 1, 2")
def knowledge_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).withColumn("knowledge_level", F.array(F.concat(F.lit("L"), (F.col("paper_id") % 4).cast("string"))))
    return reports.knowledge_tree(rows, corpus_seeds(spark, sf_dir)).where("branch <> 'seeds'").select("branch", "name", "n", "more")


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT lang AS value, count(*)::BIGINT AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE r <= 5) AS links FROM k GROUP BY lang")
def domain_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers(spark, sf_dir).withColumn("knowledge_level", F.array().cast("array<string>"))
    return reports.groups(rows, F.col("lang")).select("value", "n", F.array_join(F.transform("links", lambda x: x.cast("string")), ",").alias("links"))


@query(f"""WITH {_dry_sql()}, s AS (SELECT d.paper_id, round(raw, 4) AS dry, pos, l.quality * 3.0 AS mean_score FROM dry d LEFT JOIN labels l ON d.paper_id = l.doc_id)
SELECT paper_id, coalesce(nullif(mean_score, 0.0), dry)::DOUBLE AS best FROM s ORDER BY best DESC, pos LIMIT 10""")
def best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), (F.col("quality") * 3.0).alias("mean_score"))
    return reports.best_first(_dry(spark, sf_dir).join(said, "paper_id", "left")).select("paper_id", "best")


@query(f"""{_MATCH}, k AS (SELECT node_id AS seed_id, paper_id::VARCHAR AS paper_id, round(max(score), 3) AS score FROM m WHERE rank <= 5 GROUP BY 1, 2) SELECT * FROM k""")
def near_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    return reports.near_members(seeds.edges(_matches(spark, sf_dir)), p).select("seed_id", "paper_id", "score")


@query(f"""WITH {_dry_sql()}, s AS (SELECT *, row_number() OVER (ORDER BY pos) AS r FROM dry WHERE raw >= 0.25) SELECT paper_id FROM s WHERE r <= 8""")
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _dry(spark, sf_dir)
    return screening.passing_first(scored, scored.where("passed"), 8).select("paper_id")


@query("SELECT p_name AS ref, min('p-' || p_partkey) AS id FROM part GROUP BY p_name UNION ALL SELECT 'p-' || p_partkey, 'p-' || p_partkey FROM part UNION ALL SELECT 'no such node', NULL")
def id_or_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"))
    asked = nodes.select(F.col("title").alias("ref")).union(nodes.select("id")).union(spark.createDataFrame([("no such node",)], "ref string"))
    return ontology.resolve(nodes, asked.distinct())


@query("SELECT doc_id::VARCHAR AS paper_id, left(split_part(text, chr(10), 1), 120) AS title, (2015 + doc_id % 12)::INT AS year, source, md5(text) AS abstract_md5 FROM documents")
def search_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    rows = papers(spark, sf_dir).withColumn("paper_id", F.col("paper_id").cast("string"))
    readers.write_search_file(rows, path, QUERY, year_min=2015, sources=["src0", "absent"])
    return readers.search_file(spark, path).select("paper_id", "title", "year", "source", F.md5("abstract").alias("abstract_md5"))


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), e AS (SELECT unnest(['src0', 'absent']) AS source)
SELECT source, CASE WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'empty' END AS status, coalesce(n, 0)::INT AS n, (SELECT count(*) FROM documents)::INT AS total_papers FROM e FULL JOIN c USING (source)""")
def search_file_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    readers.write_search_file(papers(spark, sf_dir), path, QUERY, sources=["src0", "absent"])
    foot = readers.search_footer(spark, path)
    return foot.select(F.explode("statuses").alias("source", "s"), "total_papers").select("source", "s.status", F.col("s.count").alias("n"), "total_papers")


def _logged(spark: SparkSession, sf_dir: str) -> str:
    """The events, appended to a log in the shared folder."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    stream.append(e.select(F.col("ts").alias("t"), F.col("event_type").alias("e"), F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string")).alias("p"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("rest")), path)
    return path


@query("SELECT event_id::VARCHAR AS id, event_type AS e, 'user-' || user_id % 10 AS p, date_trunc('second', ts)::TIMESTAMP AS t FROM events")
def event_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.read(spark, _logged(spark, sf_dir))
    return rows.select(rows["rest"]["id"].alias("id"), "e", "p", F.date_trunc("second", "t").alias("t"))


@query("SELECT event_type AS e, 'user-' || user_id % 10 AS p, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def event_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream to its end, written by the streaming sink, and counted."""
    path = _logged(spark, sf_dir)
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    live = stream.read(spark, path, stream=True).select("t", "e", "p")
    stream.to_table(live, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("e", "p").agg(F.count("*").alias("n"))


@query(f"WITH {_GRAPH} SELECT id, source_id, target_id FROM edges")
def attached_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    loose = edges.select(F.concat(F.lit("x-"), "id").alias("id"), "source_id", F.concat(F.lit("none-"), "target_id").alias("target_id"))
    return graph.attached(edges.select("id", "source_id", "target_id").union(loose), nodes)


@query(f"WITH {_GRAPH} SELECT id, CASE WHEN type = 'seed' THEN 'newest ' || id ELSE title END AS title, type FROM nodes")
def patch_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trade_graph(spark, sf_dir)[0]
    told = nodes.where("type = 'seed'")
    changes = [told.select("id", F.concat(F.lit(w), "id").alias("title"), F.lit(None).cast("string").alias("type"), F.lit(k).alias("seq")) for k, w in enumerate(("older ", "newest "))]
    unknown = told.select(F.concat(F.lit("none-"), "id").alias("id"), F.lit("x").alias("title"), F.lit("x").alias("type"), F.lit(9).alias("seq"))
    return graph.patch(nodes, changes[1].union(changes[0]).union(unknown)).select("id", "title", "type")


@query("""WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) SELECT n::BIGINT AS id, 'customer ' || c_custkey AS description FROM o
UNION ALL SELECT (SELECT count(*) FROM customer) + n_nationkey + 1, 'nation ' || n_nationkey FROM nation""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("description"), F.struct(-F.col("c_acctbal"), F.col("c_custkey")).alias("seq"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("description"), F.col("n_nationkey").alias("seq"))
    log = graph.append(spark.createDataFrame([], "id long, description string"), c)
    return graph.append(log, n).select("id", "description")


@query("SELECT event_id::VARCHAR AS id, event_type AS e, 'user-' || user_id % 10 AS p FROM events")
def event_log_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's first part read to its end, then, from the checkpoint, what came after."""
    out = f"{shared_dir(spark)}/resumed-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("ts").alias("t"), F.col("event_type").alias("e"), F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string")).alias("p"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("rest"))
    middle = e.agg(((F.min("event_id") + F.max("event_id")) / 2).cast("long")).first()[0]
    for part in (rows["rest"]["id"].cast("long") <= F.lit(middle), ~F.coalesce(rows["rest"]["id"].cast("long") <= F.lit(middle), F.lit(False))):
        stream.append(rows.where(part), f"{out}/log")
        live = stream.read(spark, f"{out}/log", stream=True, files=2)
        stream.to_table(live.select(live["rest"]["id"].alias("id"), "e", "p"), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def first_seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event of each kind, from a stream of three parts in order of time."""
    out = f"{shared_dir(spark)}/first-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    part = F.least(F.floor((F.unix_micros("ts") - F.col("lo")) * 3 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.lit(2))
    cut = e.join(F.broadcast(e.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")))).withColumn("part", part).select(*e.columns, "part")
    keys = ["user_id", "event_type"]
    for i in range(3):
        cut.where(F.col("part") == i).drop("part").write.mode("append").parquet(f"{out}/events")
        live = spark.readStream.schema(e.schema).parquet(f"{out}/events")
        stream.to_table(stream.first_by_time(live, keys), f"{out}/rows", f"{out}/state").awaitTermination()
    return stream.settled(spark.read.parquet(f"{out}/rows"), keys).select(*keys, "event_id")


@query("SELECT doc_id AS paper_id, round((1.0 + quality * 3 + toxic) / 1.0, 2)::DOUBLE AS mean_score FROM labels")
def review_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of a stream of papers, kept batch by batch; the second half comes later, with all of the first again."""
    out = f"{shared_dir(spark)}/reviews-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), "quality", "toxic")
    kept = Results(spark, f"{out}/results", "paper_id long, mean_score double")
    work = lambda p: p.select("paper_id", F.round(1.0 + F.col("quality") * 3 + F.col("toxic"), 2).alias("mean_score"))
    for some in (rows.where("paper_id % 2 = 0"), rows):
        some.write.mode("append").parquet(f"{out}/papers")
        live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{out}/papers")
        kept.follow(live, f"{out}/state", work).awaitTermination()
    return kept.read()


@query(f"""WITH {_PAPERS}, q AS (SELECT *, '"' || replace(replace(coalesce(title, ''), '\\', '\\\\'), '"', '\\"') || '"' AS t FROM papers)
SELECT 'papers/' || paper_id || '.md' AS name, sha256(concat('---', chr(10), 'id: "', paper_id, '"', chr(10), 'title: ', t, chr(10), 'year: ', year, chr(10), 'b1: —', chr(10), '---', chr(10), chr(10), '# ', coalesce(title, ''), chr(10), chr(10), coalesce(abstract, ''), chr(10))) AS text_sha256 FROM q""")
def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a paper, written by tasks and read back."""
    path = f"{shared_dir(spark)}/vault-{uuid.uuid4().hex}"
    render.write_files(render.plain_notes(papers(spark, sf_dir)), path)
    return notes.read(spark, path).select("name", F.sha2("text", 256).alias("text_sha256"))


_ORDERED = """v AS (SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderdate < DATE '1997-01-01' THEN 0 WHEN o_orderdate < DATE '1999-01-01' THEN 1 ELSE 2 END, o_orderkey) AS seq FROM orders)"""


def _versions(spark: SparkSession, sf_dir: str) -> Versions:
    """Customers by their orders: each order is a new version of its customer, in three parts by date."""
    found = Versions(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", "id string, order long")
    day = F.col("o_orderdate").cast("date")
    part = F.when(day < F.lit("1997-01-01").cast("date"), 0).when(day < F.lit("1999-01-01").cast("date"), 1).otherwise(2)
    rows = table(spark, sf_dir, "orders").select(part.alias("part"), F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderkey").cast("long").alias("order"))
    for i in range(3):
        found.append(rows.where(F.col("part") == i).select("id", "order"), "order")
    return found


@query(f"WITH {_ORDERED} SELECT 'c-' || o_custkey AS id, o_orderkey::BIGINT AS \"order\", seq::BIGINT AS seq FROM v ORDER BY seq DESC LIMIT 50")
def history_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 changes, from the last part alone."""
    return _versions(spark, sf_dir).newest(50)


@query(f"WITH {_ORDERED} SELECT 'c-' || o_custkey AS id, max_by(o_orderkey, seq)::BIGINT AS \"order\", max(seq)::BIGINT AS seq FROM v GROUP BY o_custkey ORDER BY seq DESC LIMIT 20")
def nodes_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nodes changed last, as they are now."""
    return _versions(spark, sf_dir).newest_current(20)


@query(f"WITH {_ORDERED} SELECT 'c-' || o_custkey AS id, max_by(o_orderkey, seq)::BIGINT AS \"order\", max(seq)::BIGINT AS seq FROM v GROUP BY o_custkey")
def nodes_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes as they are now, after their versions were made one base."""
    found = _versions(spark, sf_dir)
    found.compact()
    return found.current()


@query("""WITH k AS (SELECT 'user-' || user_id % 10 AS p, CASE event_type WHEN 'view' THEN 'phase_start' WHEN 'purchase' THEN 'phase_end' WHEN 'click' THEN 'item_scored' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'degradation' END AS e, event_id % 9 AS n FROM events), g AS (
  SELECT p, count(*) FILTER (WHERE e = 'phase_start')::BIGINT AS started, count(*) FILTER (WHERE e = 'phase_end')::BIGINT AS ended, count(*) FILTER (WHERE e = 'item_scored')::BIGINT AS scored, count(*) FILTER (WHERE e = 'error')::BIGINT AS errors, count(*) FILTER (WHERE e = 'degradation')::BIGINT AS degradations, sum(n)::BIGINT AS tokens FROM k GROUP BY p)
SELECT *, CASE WHEN ended > 0 THEN CASE WHEN errors > 0 THEN 'done_with_errors' ELSE 'done' END WHEN started > 0 THEN 'running' ELSE 'pending' END AS status FROM g""")
def running_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a stream of events, gathered by the pass that writes them."""
    out = f"{shared_dir(spark)}/counted-{uuid.uuid4().hex}"
    kind = F.create_map(*[F.lit(x) for x in ("view", "phase_start", "purchase", "phase_end", "click", "item_scored", "error", "error", "signup", "degradation")])
    e = table(spark, sf_dir, "events")
    stream.append(e.select(F.col("ts").alias("t"), kind[F.col("event_type")].alias("e"), F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string")).alias("p"), F.create_map(F.lit("tokens_in"), (F.col("event_id") % 9).cast("string")).alias("rest")), f"{out}/log")
    progress = Progress(tuple(f"user-{i}" for i in range(10)), name=f"counted-{uuid.uuid4().hex}")
    listener = Listener(progress)
    spark.streams.addListener(listener)
    try:
        live = progress.watched(stream.read(spark, f"{out}/log", stream=True, files=2))
        listener.wait(stream.to_table(live, f"{out}/rows", f"{out}/state"))
    finally:
        spark.streams.removeListener(listener)
    return progress.table(spark)


@query(f"WITH {_PAPERS} SELECT paper_id::VARCHAR AS paper_id, year, source, md5(title) AS title_md5, md5(abstract) AS abstract_md5 FROM papers WHERE year BETWEEN 2018 AND 2024 AND source IN ('src0', 'src1', 'src2') AND contains(lower(title || chr(10) || abstract), '{QUERY.split()[0]}')")
def landed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed papers of some years and sources with a word, read in ranges of the files."""
    path = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    readers.write_search_file(papers(spark, sf_dir).withColumn("paper_id", F.col("paper_id").cast("string")), path, QUERY)
    found = landed.load(spark, path, query=QUERY.split()[0], split_bytes=1 << 24)
    kept = found.where((F.col("year") >= 2018) & (F.col("year") <= 2024) & F.col("source").isin("src0", "src1", "src2"))
    return kept.select("paper_id", "year", "source", F.md5("title").alias("title_md5"), F.md5("abstract").alias("abstract_md5"))
