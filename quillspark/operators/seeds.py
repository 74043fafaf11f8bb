"""Ontology seeds: a small dimension table that papers are matched to, and retrieval of related papers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..sources.tables import stored

TOP, LEAST = 5, 0.15
PREFIXES = "^(method|math|phys|axiom|meta)-"


def label(level: Column, category: Column) -> Column:
    return F.concat(F.lit("L"), level.cast("string"), F.lit("-"), F.coalesce(category, F.lit("general")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: a column that a lambda names would be put in its place, and worked out at each use."""
    return F.get(F.transform(F.array(value), body), 0)


def _best(papers: DataFrame, seeds: DataFrame, top: int = TOP, least: float = LEAST, title_only: bool = False) -> DataFrame:
    """(paper_id, best) with an array of each paper's best seeds; ties go by ``seed_pos``.

    The seeds are a dimension of a few dozen rows, and their number does not grow with the papers: they are
    gathered into one row that is joined to every paper, and scored inside it, so no row of a paper is
    repeated and the best are taken without a shuffle.
    """
    tokens = T.token_set(F.concat_ws(" ", F.col("title"), F.lit("") if title_only else F.col("abstract")))
    title = F.lower(T.text_or_empty(F.col("title")))
    abstract = F.lit("") if title_only else T.text_or_empty(F.col("abstract"))
    rows = papers.select("paper_id", tokens.alias("_w"), title.alias("_title"), F.lower(F.concat(T.text_or_empty(F.col("title")), F.lit(" "), abstract)).alias("_text"))
    phrases = F.transform(F.concat(F.array(T.text_or_empty(F.col("name"))), F.coalesce(F.col("aliases"), F.array().cast("array<string>"))), F.lower)
    seed = F.struct("seed_pos", "node_id", "level", "category", F.array_distinct("keywords").alias("k"), phrases.alias("p"))
    all_phrases = F.filter(F.array_distinct(F.flatten(F.collect_list(phrases))), lambda p: F.length(p) > 3)
    packed = seeds.where(F.size("keywords") > 0).agg(F.array_sort(F.collect_list(seed)).alias("_seeds"), F.array_distinct(F.flatten(F.collect_list("keywords"))).alias("_all"), all_phrases.alias("_phrases"))

    def raised(s: Column, met: Column) -> Column:
        # a paper's words and text are met with all keywords and phrases once, so that each seed looks through a few only
        overlap = _let(F.size(F.array_intersect(s["k"], met["known"])), lambda both: both / (met["n"] + F.size(s["k"]) - both))
        in_text = lambda p: F.when(F.array_contains(met["seen"], p), F.when(F.length(p) > 5, 0.15).otherwise(0.08)).otherwise(0.0)
        in_title = lambda p: F.when((F.length(p) > 4) & F.array_contains(met["titled"], p), 0.20).otherwise(0.0)
        return overlap + F.aggregate(s["p"], F.lit(0.0), lambda total, p: total + in_text(p)) + F.aggregate(s["p"], F.lit(0.0), lambda total, p: total + in_title(p))

    def scored(s: Column, score: Column) -> Column:
        return F.struct((-score).alias("order"), s["seed_pos"].alias("seed_pos"), s["node_id"].alias("node_id"), s["level"].alias("level"), s["category"].alias("category"), score.alias("score"))

    def ranked(met: Column) -> Column:
        all_ = F.transform("_seeds", lambda s: _let(F.least(F.lit(1.0), raised(s, met)), lambda score: scored(s, score)))
        return F.slice(F.array_sort(F.filter(all_, lambda x: (x["score"] >= least) & (met["n"] > 0))), 1, top)

    seen = lambda text: F.filter("_phrases", lambda p: F.contains(text, p))
    met = F.struct(F.array_intersect("_w", "_all").alias("known"), F.size("_w").alias("n"), seen(F.col("_text")).alias("seen"), seen(F.col("_title")).alias("titled"))
    return rows.join(F.broadcast(packed)).select("paper_id", _let(met, ranked).alias("best"))


def match(papers: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    """(paper_id, node_id, level, category, score, rank) of each paper's best seeds."""
    found = _best(papers, seeds, **options).select("paper_id", F.posexplode_outer("best").alias("_i", "_s")).where("_i IS NOT NULL")  # an inner one would have the array worked out once more, for its size
    return found.select("paper_id", "_s.node_id", "_s.level", "_s.category", "_s.score", (F.col("_i") + 1).alias("rank"))


def match_rows(papers: DataFrame, seeds: DataFrame, **options) -> DataFrame:
    """One row a paper: levels in order of rank, confidence, seeds and their scores; papers without a match have empty ones."""
    mean = F.aggregate("best", F.lit(0.0), lambda a, x: a + x["score"]) / F.greatest(F.size("best"), F.lit(1))
    return _best(papers, seeds, **options).select(  # the paper's row has all it takes: nothing is shuffled
        "paper_id",
        F.array_distinct(F.transform("best", lambda x: label(x["level"], x["category"]))).alias("knowledge_level"),
        F.round(mean, 3).alias("knowledge_level_confidence"),
        F.transform("best", lambda x: x["node_id"]).alias("matched_seeds"),
        F.map_from_entries(F.transform("best", lambda x: F.struct(x["node_id"], F.round(x["score"], 3)))).alias("match_scores"),
    )


def edges(matches: DataFrame) -> DataFrame:
    """An edge from paper to seed for each score of ``match_rows``."""
    rows = matches.select("paper_id", F.explode_outer("match_scores").alias("seed_id", "score")).where("seed_id IS NOT NULL")
    return rows.select(T.edge_id(F.col("paper_id").cast("string"), F.col("seed_id")).alias("id"), F.col("paper_id").cast("string").alias("source_id"), F.col("seed_id").alias("target_id"), F.col("score").alias("base_score"))


def per_level(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy("level").agg(F.count("*").alias("n"))


def of_levels(nodes: DataFrame, prefixes: tuple[str, ...] = ("L1", "L2", "L3", "L4")) -> DataFrame:
    """Seed nodes with a level label that starts with one of the prefixes."""
    test = lambda x: sum((F.startswith(x, F.lit(p)).cast("int") for p in prefixes), F.lit(0)) > 0
    return nodes.where((F.col("type") == "seed") & F.exists("knowledge_level", test))


def level_proximity(a: Column, b: Column) -> Column:
    """The largest 1 - 0.15 * |x - y| over pairs of level numbers; 0 without a pair."""

    def numbers(c: Column) -> Column:
        return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.level_number), lambda x: x.isNotNull())

    pairs = F.flatten(F.transform(numbers(a), lambda x: F.transform(numbers(b), lambda y: 1.0 - 0.15 * F.abs(x - y))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


#: Known papers of a tile at least, and tiles of a new paper at most, as long as no tile has over ``WIDEST``; new papers of a tile.
COMMON, TILES, WIDEST, ASKED = 4096, 64, 1 << 16, 1 << 15


def retrieve(new: DataFrame, known: DataFrame, top: int = 15, common: int = COMMON) -> DataFrame:
    """(new_id, paper_id, relevance, rank): the known papers most like each new one.

    Half of the relevance is the Jaccard overlap of words over three letters of the title (and keywords), half the
    proximity of levels.  Blocks of new and of known papers (of ``common`` or more) meet in tiles, each one task's: it counts the words
    that a new paper shares with all known ones of the tile by the tile's own inverted index, and gives the ``top`` of them.
    So pairs are never rows: what is shuffled is the papers' words and ``top`` rows a new paper and tile,
    and a task holds one tile whatever the words' frequencies are.
    """
    keywords = lambda df: F.transform(F.coalesce(F.col("keywords"), F.array().cast("array<string>")), lambda k: F.lower(F.trim(k))) if "keywords" in df.columns else F.array().cast("array<string>")
    levels = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(F.col("knowledge_level"), F.array().cast("array<string>")), T.level_number), lambda x: x.isNotNull())))
    a = stored(new.where("paper_id IS NOT NULL").select(F.col("paper_id").alias("id"), F.array_distinct(F.concat(T.long_words(F.col("title")), keywords(new))).alias("w"), levels.alias("l")), "retrieve-new")
    b = stored(known.where("paper_id IS NOT NULL").select(F.col("paper_id").alias("id"), T.long_words(F.col("title")).alias("w"), levels.alias("l")), "retrieve-known")
    n = b.count()
    x, y = max(1, -(-a.count() // ASKED)), max(1, -(-n // min(WIDEST, max(common, -(-n // TILES)))))
    spread = lambda of, to: F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(to)
    block = lambda of, to: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int").alias(to)
    asked = a.select(block(x, "x"), spread(y, "y"), "*").groupBy("x", "y")
    held = b.select(spread(x, "x"), block(y, "y"), "*").groupBy("x", "y")
    kind = a.schema["id"].dataType.simpleString()
    best = asked.cogroup(held).applyInArrow(lambda new, known: _nearest(new, known, top), f"new_id {kind}, paper_id {b.schema['id'].dataType.simpleString()}, relevance double")
    order = W.partitionBy("new_id").orderBy(F.desc("relevance"), "paper_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _nearest(new: pa.Table, known: pa.Table, top: int) -> pa.Table:
    """The ``top`` known papers of a tile for each new one, (id, w, l) each; equal relevance goes by id."""
    known = known.take(pc.sort_indices(known["id"]))
    word, of, size = _codes(new, known)
    n, m = len(new), len(known)
    mine, theirs = of < n, of >= n
    order = np.argsort(word[theirs], kind="stable")
    rows, start = (of[theirs] - n)[order], np.searchsorted(word[theirs][order], np.arange(word.max(initial=-1) + 2))
    asked, first = word[mine], np.searchsorted(of[mine], np.arange(n + 1))
    sets, level = np.unique([sum(1 << i for i in x or ()) for x in [*new["l"].to_pylist(), *known["l"].to_pylist()]], return_inverse=True)
    near = np.array([[max((1.0 - 0.15 * abs(i - j) for i in range(7) if s >> i & 1 for j in range(7) if t >> j & 1), default=0.0) for t in sets.tolist()] for s in sets.tolist()]).reshape(len(sets), len(sets))
    names = pa.concat_arrays([x.combine_chunks().cast(known["id"].type) for x in (new["id"], known["id"])]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    like, found = {s: 0.5 * near[s][level[n:]] for s in set(level[:n].tolist())}, ([], [], [])
    for i in range(n if m else 0):
        shared = np.bincount(np.concatenate([rows[start[w] : start[w + 1]] for w in asked[first[i] : first[i + 1]].tolist()] or [rows[:0]]), minlength=m)
        relevance = 0.5 * (shared / np.maximum(size[i] + size[n:] - shared, 1)) + like[level[i]]
        relevance[names[n:] == names[i]] = -1.0  # not itself
        if m > top:
            least = np.partition(relevance, m - top)[m - top]
            over, ties = np.flatnonzero(relevance > least), np.flatnonzero(relevance == least)
            at = np.concatenate([over, ties[: top - len(over)]])
        else:
            at = np.arange(m)
        at = at[relevance[at] >= 0]
        for out, x in zip(found, (np.full(len(at), i), at, relevance[at]), strict=True):
            out.append(x)
    i, at, relevance = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    return pa.table({"new_id": new["id"].take(pa.array(i, pa.int64())), "paper_id": known["id"].take(pa.array(at, pa.int64())), "relevance": pa.array(relevance, pa.float64())})


def _codes(new: pa.Table, known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each word, place of its paper, words of each paper) of the new papers and then the known ones."""
    lists = [x.combine_chunks() for x in (new["w"], known["w"])]
    size = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
    words = pa.concat_arrays([x.flatten().cast(pa.large_string()) for x in lists])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(size)), size), size


def template(c: Column) -> Column:
    """What ``template_similarity`` compares of a structure template, taken from its texts once: kept in the row, as each pair would cut it anew."""
    chain = F.array_distinct(F.coalesce(c["signal_chain"], F.array().cast("array<string>")))
    return F.struct(F.coalesce(c["control_architecture"], F.lit("")).alias("architecture"), T.word_set(c["abstract_pattern"]).alias("pattern"), T.word_set(c["mathematical_core"]).alias("core"), chain.alias("chain"))


def template_similarity(a: Column, b: Column) -> Column:
    """Weighted overlap of two structure templates; only parts that both have count."""
    return parts_similarity(template(a), template(b))


def parts_similarity(a: Column, b: Column) -> Column:
    """``template_similarity`` of two results of ``template``."""
    total, weight = F.lit(0.0), F.lit(0.0)
    x, y = a["architecture"], b["architecture"]
    have = (x != "") & (y != "")
    total, weight = total + F.when(have & (x == y), 0.35).otherwise(0.0), weight + F.when(have, 0.35).otherwise(0.0)
    for w, part in ((0.25, "pattern"), (0.20, "core"), (0.20, "chain")):
        p, q = a[part], b[part]
        both = (F.size(p) > 0) & (F.size(q) > 0)
        total = total + F.when(both, w * T.jaccard(p, q)).otherwise(0.0)
        weight = weight + F.when(both, w).otherwise(0.0)
    return F.when(weight > 0, F.least(F.lit(1.0), total / weight)).otherwise(F.lit(0.0))
