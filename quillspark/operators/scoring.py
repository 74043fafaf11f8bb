"""Scores of papers for a query: BM25, the five-part dry score, and composites of pluggable scorers."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hits, text_or_empty, tokens, word_hits

K1, B = 1.5, 0.5
THRESHOLD = 0.25
#: Words of a query that describe rather than name (fixed values).
BACKGROUND = frozenset(
    (
        "a an and are as at be by for from in is it of on or that the to with using based via over under between among new novel recent modern advanced improved "
        "approach method methodology framework scheme study paper article work research analysis proposed presented investigated demonstrated discussed"
    ).split()
)
#: Signs of a neighbouring field, which soften the penalty of a missing one (fixed values).
NEIGHBOURS = ("control", "adaptive", "filter", "noise", "anc", "avc", "suppression", "damping", "isolat", "actuator", "sensor", "feedback", "feedforward", "fx-lms", "fxlms", "lms", "rls")
#: Fields: a query with one of the first words asks for a paper with one of them, and without the second words (fixed values).
DOMAINS = {
    "vibration": (
        "vibration vibrating structural mechanical cantilever beam plate rotor isolator damping modal resonance seismic".split(),
        "wildfire satellite robot network image video speech audio language cancer drug clinical patient financial stock market trading social user recommend sentiment".split(),
    ),
    "power": ("power voltage current converter inverter grid battery motor generator transformer".split(), "wildfire satellite network image speech cancer drug financial social".split()),
    "aerospace": ("aircraft satellite launch spacecraft rocket aero flight wing turbine propulsion".split(), "wildfire cancer drug financial".split()),
}


def query_words(query: str) -> tuple[list[str], list[str]]:
    """The query's intent words and background words, lowered and sorted.

    A query is one short string, so it is read on the driver.
    """
    intent: set[str] = set()
    background: set[str] = set()
    telling = [re.compile(p) for p in (r"\b[A-Z]{2,}[a-zA-Z0-9]*\b", r"\b[A-Z][a-z]*[A-Z][a-zA-Z0-9]*\b", r"\b[A-Z]?\d+[a-zA-Z]*\b")]
    for word in re.findall(r"[a-zA-Z0-9]+(?:-[a-zA-Z0-9]+)*", query):
        low = word.lower()
        if low in BACKGROUND:
            background.add(low)
        elif any(p.match(word) for p in telling):
            intent.add(low)
        elif "-" in word:
            intent |= {part for part in low.split("-") if len(part) > 2 and part not in BACKGROUND}
        else:
            (intent if len(word) >= 6 else background).add(low)
    return sorted(intent), sorted(background)


def domain_of(query: str, domains: dict = DOMAINS) -> tuple[list[str], list[str]] | None:
    """The first field with a word in the query: (words to ask for, words to avoid)."""
    low = query.lower()
    return next((d for d in domains.values() if any(w in low for w in d[0])), None)


def with_tokens(papers: DataFrame) -> DataFrame:
    """Title and abstract as token arrays; null is empty."""
    return papers.withColumn("title_tokens", tokens(F.col("title"))).withColumn("abstract_tokens", tokens(F.col("abstract")))


def bm25(papers: DataFrame, query: str, out: str = "bm25") -> DataFrame:
    """``papers`` with their BM25 score for the query; a term that the query repeats adds each time.

    The statistics are one global aggregate with a column per query term, joined back as
    one row, so no row of the corpus is shuffled.
    """
    terms = re.findall(r"[a-z0-9]+", query.lower())
    distinct = sorted(set(terms))
    have = papers if {"title_tokens", "abstract_tokens"} <= set(papers.columns) else with_tokens(papers)
    counted = have.withColumn("_dl", (F.size("title_tokens") + F.size("abstract_tokens")).cast("double"))

    def count(term: str) -> Column:
        return (F.size(F.filter("title_tokens", lambda x: x == term)) + F.size(F.filter("abstract_tokens", lambda x: x == term))).cast("double")

    counted = counted.withColumn("_tf", F.array(*[count(t) for t in distinct]) if distinct else F.array().cast("array<double>"))
    stats = counted.agg(
        F.count("*").cast("double").alias("_n"),
        F.coalesce(F.avg("_dl"), F.lit(1.0)).alias("_avg"),
        F.array(*[F.sum((F.col("_tf")[i] > 0).cast("long")).cast("double") for i in range(len(distinct))]).alias("_df") if distinct else F.lit(None).cast("array<double>").alias("_df"),
    )
    rows = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("_dl") / F.nullif(F.col("_avg"), F.lit(0.0)))
    for t in terms:
        i = distinct.index(t)
        f, df = F.col("_tf")[i], F.col("_df")[i]
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1.0)
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + norm)).otherwise(0.0)
    return rows.withColumn(out, score).drop("_dl", "_tf", "_n", "_avg", "_df")


def recency_steps(year: Column, now: int) -> Column:
    age = F.lit(now) - year
    return F.when(F.coalesce(year, F.lit(0)) == 0, 0.15).when(age <= 0, 0.15).when(age == 1, 0.15 * 0.7).when(age == 2, 0.15 * 0.4).otherwise(0.0)


def impact_steps(citations: Column) -> Column:
    c = F.coalesce(citations, F.lit(0))
    return F.when(c >= 100, 0.10).when(c >= 50, 0.10 * 0.7).when(c >= 10, 0.10 * 0.4).when(c > 0, 0.10 * 0.2).otherwise(0.0)


def domain_penalty(title: Column, abstract: Column, require: Sequence[str], exclude: Sequence[str]) -> tuple[Column, Column]:
    """(factor, reason): substrings decide, and the reason lists up to three avoided words in order of the alphabet."""

    def found(words: Sequence[str]) -> Column:
        return sum((F.when(F.contains(title, F.lit(w)) | F.contains(abstract, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))

    factor, reason = F.lit(1.0), F.lit("")
    if require:
        near = found(NEIGHBOURS)
        missing = found(require) == 0
        factor = F.when(missing, F.when(near >= 2, 0.7).otherwise(0.3)).otherwise(1.0)
        reason = F.when(
            missing, F.when(near >= 2, F.format_string("neighbor_domain(missing_require, has_control_terms:%d)", near)).otherwise(F.lit(f"no_domain_word(missing:{len(set(require))})"))
        ).otherwise(F.lit(""))
    if exclude:
        bad = sorted(set(exclude))
        n = found(bad)
        factor = factor * F.when(n > 0, F.greatest(F.lit(0.1), 1.0 - n * 0.15)).otherwise(1.0)
        named = F.filter(F.array(*[F.when(F.contains(title, F.lit(w)) | F.contains(abstract, F.lit(w)), w) for w in bad]), lambda w: w.isNotNull())
        reason = F.when((reason == "") & (n > 0), F.concat(F.lit("exclude_words:"), F.concat_ws(",", F.slice(named, 1, 3)))).otherwise(reason)
    return factor, reason


def dry_score(papers: DataFrame, query: str, *, now: int, intent: Sequence[str] | None = None, background: Sequence[str] | None = None, require: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """``papers`` with dry_score (4 places), dry_raw (not rounded), dry_detail, passed and reason.

    The gate tests the raw score.
    """
    if intent is None or background is None:
        intent, background = query_words(query)
    intent, background = sorted(set(intent)), sorted(set(background))
    rows = bm25(with_tokens(papers), query, "_bm25")
    in_title, in_abstract = word_hits(F.col("title_tokens"), intent), word_hits(F.col("abstract_tokens"), intent)
    both = sum(((F.array_contains("title_tokens", w) | F.array_contains("abstract_tokens", w)).cast("int") for w in background), F.lit(0))
    factor, domain_reason = domain_penalty(F.lower(text_or_empty(F.col("title"))), F.lower(text_or_empty(F.col("abstract"))), require, exclude)
    rows = rows.withColumns(
        {
            "_b": F.least(F.col("_bm25") / 10.0, F.lit(1.0)),
            "_it": in_title,
            "_ia": in_abstract,
            "_bg": F.least(both / F.lit(float(max(len(background), 1))), F.lit(1.0)) * 0.2,
            "_re": recency_steps(F.col("year"), now),
            "_im": impact_steps(F.col("citations")),
            "_factor": factor,
            "_domain": domain_reason,
        }
    )
    rows = rows.withColumn("_i", F.least((F.col("_it") * 3.0 + F.col("_ia") * 1.5) / F.lit(len(intent) * 3.0), F.lit(1.0)) if intent else F.lit(0.0))
    rows = rows.withColumn("dry_raw", (F.col("_b") * 0.30 + F.col("_i") * 0.40 + F.col("_bg") * 0.10 + F.col("_re") * 0.10 + F.col("_im") * 0.10) * F.col("_factor"))
    passed = F.col("dry_raw") >= THRESHOLD
    reason = F.concat_ws(
        "; ",
        F.when(F.col("_it") > 0, F.format_string("intent_in_title:%d", F.col("_it"))),
        F.when(F.col("_ia") > 0, F.format_string("intent_in_abstract:%d", F.col("_ia"))),
        F.when(~passed, F.format_string(f"below_threshold(%.3f<{THRESHOLD})", F.col("dry_raw"))),
        F.nullif(F.col("_domain"), F.lit("")),
    )
    parts = (("bm25", "_b"), ("intent", "_i"), ("bg_match", "_bg"), ("recency", "_re"), ("impact", "_im"))
    rows = rows.withColumns(
        {
            "dry_score": F.round("dry_raw", 4),
            "dry_detail": F.struct(*[F.round(c, 4).alias(n) for n, c in parts]),
            "passed": passed,
            "reason": F.when(reason == "", "no_match").otherwise(reason),
        }
    )
    return rows.select(*papers.columns, "dry_score", "dry_raw", "dry_detail", "passed", "reason")


def ranked(scored: DataFrame, score: str = "dry_score", pos: str = "pos") -> DataFrame:
    """Best first; ties keep the order of the input."""
    return scored.orderBy(F.desc(score), pos)


@dataclasses.dataclass(frozen=True)
class Context:
    """What a scorer may need besides a row."""

    query: str = ""
    intent: tuple[str, ...] = ()
    background: tuple[str, ...] = ()
    now: int = 2026


#: A scorer is a function from the context to a column in [0, 1] over paper and enrichment columns.
Scorer = Callable[[Context], Column]
SCORERS: dict[str, Scorer] = {}
#: Default weights (fixed values).
WEIGHTS = {"bm25": 0.30, "intent": 0.40, "background": 0.10, "recency": 0.10, "impact": 0.10, "venue": 0.10, "author": 0.05}
TOP_VENUES = ("nature", "science", "cell", "pnas", "physical review letters")
GOOD_VENUES = ("ieee transactions", "acm transactions", "neurips", "icml", "iclr", "cvpr", "iccv", "eccv", "acl", "emnlp", "aaai", "ijcai")


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    """Register a scorer under a name."""

    def add(f: Scorer) -> Scorer:
        SCORERS[name] = f
        return f

    return add


@scorer("bm25")
def _bm25(_: Context) -> Column:
    return F.least(F.col("_bm25") / 10.0, F.lit(1.0))


@scorer("intent")
def _intent(c: Context) -> Column:
    title, abstract = F.lower(text_or_empty(F.col("title"))), F.lower(text_or_empty(F.col("abstract")))
    return F.least(F.lit(1.0), (hits(title, c.intent) * 3.0 + hits(abstract, c.intent) * 1.5) / F.lit(float(max(len(c.intent) * 3, 1))))


@scorer("background")
def _background(c: Context) -> Column:
    title, abstract = F.lower(text_or_empty(F.col("title"))), F.lower(text_or_empty(F.col("abstract")))
    n = sum(((F.contains(title, F.lit(w)) | F.contains(abstract, F.lit(w))).cast("int") for w in c.background), F.lit(0))
    return F.least(F.lit(1.0), n / F.lit(max(len(c.background) * 0.3, 1.0))) if c.background else F.lit(0.0)


@scorer("recency")
def _recency(c: Context) -> Column:
    year = F.coalesce(F.col("year"), F.lit(0))
    age = F.lit(c.now) - year
    return F.when((year == 0) | (year > c.now), 0.5).when(age <= 5, F.greatest(F.lit(0.0), 1.0 - age / F.lit(5.0))).otherwise(0.0)


def _cited() -> Column:
    return F.coalesce(F.nullif(F.greatest(F.coalesce(F.col("meta.citations"), F.lit(0)), F.coalesce(F.col("meta.cited_by_count"), F.lit(0))), F.lit(0)), F.col("citations"), F.lit(0))


@scorer("impact")
def _impact(_: Context) -> Column:
    n = _cited()
    return F.when(n >= 100, 1.0).when(n >= 10, 0.5).when(n >= 1, 0.2).otherwise(0.0)


@scorer("venue")
def _venue(_: Context) -> Column:
    name = F.lower(F.coalesce(F.nullif(F.col("meta.venue_name"), F.lit("")), F.col("venue"), F.lit("")))
    return F.when(name == "", 0.0).when(hits(name, TOP_VENUES) > 0, 1.0).when(hits(name, GOOD_VENUES) > 0, 0.6).otherwise(0.3)


@scorer("author")
def _author(_: Context) -> Column:
    n = F.coalesce(F.nullif(F.col("meta.cited_by_count"), F.lit(0)), F.col("citations"), F.lit(0))
    people = F.greatest(F.lit(1), F.coalesce(F.col("meta.author_count"), F.lit(2)))
    return F.least(F.lit(1.0), n / people / F.lit(50.0))


META = "struct<citations: int, cited_by_count: int, venue_name: string, author_count: int>"


class Composite:
    """A weighted mean of scorers, with enrichment tables joined on first.

    ``add_source`` takes a table keyed by ``paper_id`` with any fields of ``META``; of two
    sources that know a field the later wins.  A scorer that raises while its
    column is built, or gives null, counts as 0 with its full weight.
    """

    def __init__(self, context: Context):
        self.context = context
        self.scorers: list[tuple[str, Scorer, float]] = []
        self.sources: list[DataFrame] = []

    @classmethod
    def default(cls, query: str, *, now: int = 2026, weights: dict[str, float] | None = None, extra: Sequence[str] = ()) -> "Composite":
        intent, background = query_words(query)
        made = cls(Context(query, tuple(intent), tuple(background), now))
        for name in ("bm25", "intent", "background", "recency", "impact", *extra):
            made.add_scorer(name, (weights or {}).get(name, WEIGHTS.get(name, 0.1)))
        return made

    def add_scorer(self, name: str, weight: float, f: Scorer | None = None) -> "Composite":
        self.scorers.append((name, f or SCORERS[name], weight))
        return self

    def add_source(self, table: DataFrame) -> "Composite":
        self.sources.append(table)
        return self

    def score(self, papers: DataFrame) -> DataFrame:
        """``papers`` with ``meta``, ``scores`` (a struct for each scorer) and ``composite``."""
        names = [x.split(":")[0].strip() for x in META[7:-1].split(",")]
        rows = papers
        kinds = dict(zip(names, ("int", "int", "string", "int"), strict=True))
        for n in names:
            rows = rows.withColumn(f"_m_{n}", F.lit(None).cast(kinds[n]))
        for table in self.sources:
            known = [n for n in names if n in table.columns]
            new = table.groupBy("paper_id").agg(*[F.first(n, ignorenulls=True).alias(f"_s_{n}") for n in known])
            rows = rows.join(new, "paper_id", "left")
            for n in known:
                rows = rows.withColumn(f"_m_{n}", F.coalesce(F.col(f"_s_{n}").cast(kinds[n]), F.col(f"_m_{n}"))).drop(f"_s_{n}")
        rows = rows.withColumn("meta", F.struct(*[F.col(f"_m_{n}").alias(n) for n in names])).drop(*[f"_m_{n}" for n in names])
        rows = bm25(rows, self.context.query, "_bm25")
        total, weight, shown = F.lit(0.0), 0.0, []
        for name, f, w in self.scorers:
            try:
                value = F.coalesce(f(self.context).cast("double"), F.lit(0.0))
            except Exception:  # a plugin of the user's; its failure must not lose the others' scores
                value = F.lit(0.0)
            total, weight = total + value * w, weight + w
            shown.append(F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(w).alias("weight"), (value * w).alias("weighted")))
        rows = rows.withColumn("scores", F.array(*shown)).withColumn("composite", total / F.lit(weight) if weight else F.lit(0.0))
        return rows.drop("_bm25", "title_tokens", "abstract_tokens")


def stated_citations(comment: Column) -> Column:
    """Citations that a paper's comment states, or 0."""
    return F.coalesce(F.regexp_extract(text_or_empty(comment), r"(?i)(\d+)\s*citations?", 1).try_cast("int"), F.lit(0))
