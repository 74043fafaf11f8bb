"""One search over many sources, with further ones asked only while there is too little."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import COMPUTING
from ..operators import dedup, reports, screening
from .tables import stored

ENOUGH = 15
Source = Callable[[str], DataFrame]


def is_chinese(query: str) -> bool:
    return any("一" <= c <= "鿿" for c in query)


def is_computing(query: str) -> bool:
    return any(w in query.lower() for w in COMPUTING)


def unified_search(query: str, first: dict[str, Source], *, computing: dict[str, Source] | None = None, scholar: dict[str, Source] | None = None, chinese: dict[str, Source] | None = None, chinese_more: dict[str, Source] | None = None, year_min: int | None = None, year_max: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(papers, status of sources).  A source is a function from the query to papers with ``pos``.

    Steps: all of ``first``; ``computing`` for such a query and ``scholar`` for any while there are
    fewer than ``ENOUGH``; ``chinese`` for a query in it, ``chinese_more`` while there are too few.  Duplicates go after
    each step; then years are tested and the most cited and newest come first.
    """
    asked: list[str] = []
    papers: DataFrame | None = None

    def step(sources: dict[str, Source] | None, wanted: bool, only_if_few: bool) -> None:
        nonlocal papers
        if not sources or not wanted or (only_if_few and papers is not None and len(papers.limit(ENOUGH).select("pos").collect()) >= ENOUGH):
            return
        found = [f(query).withColumn("_s", F.lit(len(asked) + i)) for i, f in enumerate(sources.values())]
        asked.extend(sources)
        new = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
        new = new.withColumn("pos", F.col("_s").cast("long") * (1 << 40) + F.col("pos")).drop("_s")
        whole = new if papers is None else papers.unionByName(new, allowMissingColumns=True)
        papers = stored(dedup.whole(whole), "search")

    step(first, True, False)
    step(computing, is_computing(query), True)
    step(scholar, True, True)
    step(chinese, is_chinese(query), False)
    step(chinese_more, is_chinese(query), True)
    kept = screening.years(papers, year_min, year_max) if year_min is not None or year_max is not None else papers
    return kept.orderBy(F.desc("citations"), F.desc("year"), "pos"), reports.source_counts(papers, asked)
