"""Readers of landed files: search files, connector records, seeds, prompts; and writers of the same.

Connectors read what was landed from a service.  What a service calls a field is
settled in one projection here, so that no later operator looks at raw names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .. import model
from ..functions import text as T
from .tables import stored

HEADER, FOOTER = "search_metadata", "sources_status"
#: Names under which services give a field, first that is not blank (fixed values).
NAMES = {
    "title": ("title", "name", "标题", "题目"),
    "authors": ("authors", "作者"),
    "year": ("year", "date", "published", "日期", "出版年份"),
    "venue": ("venue", "journal", "conference", "journal_name", "期刊", "会议"),
    "abstract": ("abstract", "snippet", "摘要", "description"),
    "doi": ("doi", "DOI"),
    "arxiv_id": ("arxiv_id", "id"),
    "citations": ("citations", "citation_count", "cited_by"),
    "url": ("url", "link", "href"),
    "pdf_url": ("pdf_url", "pdf"),
    "paper_id": ("id", "paper_id"),
}
#: Keys that wrap a list of records (fixed values).
WRAPPERS = ("results", "items", "data", "hits")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines that parse: (json, pos).  ``pos`` rises within a file in order of its lines."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    return lines.where(F.try_parse_json("value").isNotNull()).select(F.col("value").alias("json"), "pos")


def search_file(spark: SparkSession, path: str) -> DataFrame:
    """Papers of a search file; lines that are no JSON, the header and the footer are skipped."""
    rows = _lines(spark, path).where(~F.coalesce(F.get_json_object("json", "$.type"), F.lit("")).isin(HEADER, FOOTER))
    return rows.select(F.from_json("json", model.PAPER).alias("p"), "pos").select("p.*", "pos")


def search_header(spark: SparkSession, path: str) -> DataFrame:
    kind = "query string, year_min int, year_max int, sources array<string>, started_at string, streaming boolean"
    return _lines(spark, path).where(F.get_json_object("json", "$.type") == HEADER).select(F.from_json("json", kind).alias("h")).select("h.*").limit(1)


def search_footer(spark: SparkSession, path: str) -> DataFrame:
    kind = "statuses map<string, struct<status: string, count: int>>, total_papers int"
    return _lines(spark, path).where(F.get_json_object("json", "$.type") == FOOTER).select(F.from_json("json", kind).alias("f"), "pos").orderBy(F.desc("pos")).limit(1).select("f.*")


def write_search_file(papers: DataFrame, path: str, query: str, *, year_min: int | None = None, year_max: int | None = None, sources: list[str] | None = None, started_at: str = "") -> None:
    """Header, papers and footer as JSON lines in one folder; counts come from one aggregate."""
    spark = papers.sparkSession
    header = spark.range(1).select(F.to_json(F.struct(F.lit(HEADER).alias("type"), F.lit(query).alias("query"), F.lit(year_min).cast("int").alias("year_min"), F.lit(year_max).cast("int").alias("year_max"), F.array(*map(F.lit, sources or [])).cast("array<string>").alias("sources"), F.lit(started_at).alias("started_at"), F.lit(True).alias("streaming"))).alias("value"))
    counts = papers.groupBy("source").agg(F.count("*").cast("int").alias("n"))
    if sources:
        asked = spark.createDataFrame([(s,) for s in sources], "source string")
        counts = asked.join(counts, "source", "full")
    n = F.coalesce("n", F.lit(0))
    entry = F.struct(F.col("source"), F.struct(F.when(n > 0, "ok").otherwise("empty").alias("status"), n.alias("count")))
    footer = counts.agg(F.to_json(F.struct(F.lit(FOOTER).alias("type"), F.map_from_entries(F.collect_list(entry)).alias("statuses"), F.coalesce(F.sum(n), F.lit(0)).alias("total_papers"))).alias("value"))
    body = papers.select(F.to_json(F.struct(*[c for c in papers.columns if c != "pos"])).alias("value"))
    body.write.text(path)
    header.write.mode("append").text(path)
    footer.write.mode("append").text(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(raw map, pos) of records landed as JSON lines, a JSON list, or a list under a wrapper key; ``pos`` rises within a file and is no other row's."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    kind = "array<map<string,string>>"
    inner = F.coalesce(F.when(F.startswith("v", F.lit("[")), F.from_json("v", kind)), *[F.from_json(F.get_json_object("v", f"$.{w}"), kind) for w in WRAPPERS])
    lines = F.filter(F.transform(F.split("v", "\n"), lambda x: F.from_json(x, "map<string,string>")), lambda m: m.isNotNull())
    return whole.select(F.explode(F.coalesce(inner, lines)).alias("raw")).withColumn("pos", F.monotonically_increasing_id())


def unified(rows: DataFrame, source: str, raw: str = "raw") -> DataFrame:
    """Connector records (raw map, pos) in the schema of papers; rows with a blank title go."""

    def first(name: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.try_element_at(F.col(raw), F.lit(k))), F.lit("")) for k in NAMES[name]])

    authors = first("authors")
    listed = F.coalesce(F.when(F.startswith(authors, F.lit("[")), F.from_json(authors, "array<string>")), F.filter(F.transform(F.split(authors, r"[;,|]\s*"), lambda a: F.trim(a)), lambda a: a != ""), F.array().cast("array<string>"))
    doi = first("doi")
    in_arxiv = F.contains(F.lower(F.to_json(F.col(raw))), F.lit("arxiv"))
    title, abstract = T.text_or_empty(first("title")), T.text_or_empty(first("abstract"))
    rows = rows.select(
        F.coalesce(first("paper_id"), F.lower(F.hex(F.xxhash64(title)))).alias("paper_id"), title.alias("title"), listed.alias("authors"), T.year_in(first("year")).alias("year"), T.text_or_empty(first("venue")).alias("venue"),
        abstract.alias("abstract"), F.length(abstract).alias("abstract_length"), F.coalesce(first("citations").try_cast("int"), F.lit(0)).alias("citations"), F.lit(source).alias("source"),
        F.coalesce(T.doi(doi), F.lit("")).alias("doi"), F.coalesce(F.when(in_arxiv, T.arxiv_id(first("arxiv_id"))), F.lit("")).alias("arxiv_id"), F.lit("unknown").alias("oa_status"),
        T.text_or_empty(first("pdf_url")).alias("pdf_url"), T.text_or_empty(first("url")).alias("url"), "pos",
    )
    return rows.where("title <> ''")


WORK = (
    "id string, title string, publication_year int, cited_by_count int, doi string, authorships array<struct<author: struct<display_name: string>>>, abstract_inverted_index map<string, array<int>>, "
    "open_access struct<oa_status: string, oa_url: string>, primary_location struct<landing_page_url: string, source: struct<display_name: string>>, "
    "locations array<struct<landing_page_url: string, source: struct<display_name: string>>>"
)


def inverted_index(rows: DataFrame, id: str, words: str) -> DataFrame:
    """(id, i) of rows (id, words): a map from each word to its places, in order.

    A row's words are sorted and cut into runs inside the row, so no word is shuffled; only rows that share an id
    with another are gathered, word by word.
    """
    ids = stored(rows.groupBy(id).agg(F.count("*").alias("_n")).where("_n > 1").select(id), "shared-ids")  # of known size: rows are not shuffled to meet a few
    shared = rows.join(ids, rows[id].eqNullSafe(ids[id]), "left_semi")
    own = rows.join(ids, rows[id].eqNullSafe(ids[id]), "left_anti")
    ordered = own.select(id, F.array_sort(F.transform(words, lambda w, p: F.struct(w.alias("word"), p.alias("p")))).alias("_s"))
    started = ordered.withColumn("_at", F.filter(F.transform("_s", lambda e, k: F.when((k == 0) | (e["word"] != F.get("_s", k - 1)["word"]), k)), lambda k: k.isNotNull()))
    run = lambda k, j: F.slice("_s", k + 1, F.coalesce(F.get("_at", j + 1), F.size("_s")) - k)
    entries = F.transform("_at", lambda k, j: F.struct(F.get("_s", k)["word"].alias("word"), F.transform(run(k, j), lambda e: e["p"]).alias("ps")))
    whole = started.select(id, F.map_from_entries(entries).alias("i"))
    if ids.isEmpty():
        return whole
    pairs = shared.select(id, F.posexplode(words).alias("p", "word")).groupBy(id, "word").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return whole.unionByName(pairs.groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("word", "ps"))).alias("i")))


def rebuilt_abstract(index: Column) -> Column:
    """Words of an inverted index in order of their first position, each once."""
    return F.array_join(F.transform(F.array_sort(F.transform(F.map_entries(index), lambda e: F.struct(e["value"][0].alias("p"), e["key"].alias("w")))), lambda x: x["w"]), " ")


def location_arxiv_id(primary: Column, others: Column) -> Column:
    """The arXiv id of the first location that has one, the primary one first."""
    pages = F.concat(F.array(primary["landing_page_url"]), F.transform(F.coalesce(others, F.array().cast("array<struct<landing_page_url: string, source: struct<display_name: string>>>")), lambda x: x["landing_page_url"]))
    ids = F.filter(F.transform(F.filter(pages, lambda u: F.contains(F.lower(u), F.lit("arxiv"))), T.arxiv_id), lambda x: x.isNotNull())
    return F.get(ids, 0)


def works(rows: DataFrame, source: str = "works", *, year_min: int | None = None, year_max: int | None = None) -> DataFrame:
    """Landed work records (``WORK``) in the schema of papers; works without an abstract go.  The year test reaches the scan."""
    if year_min is not None:
        rows = rows.where(F.col("publication_year") >= year_min)
    if year_max is not None:
        rows = rows.where(F.col("publication_year") <= year_max)
    abstract = T.text_or_empty(rebuilt_abstract(F.col("abstract_inverted_index")))
    out = rows.select(
        F.col("id").alias("paper_id"), T.text_or_empty(F.col("title")).alias("title"), F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull()).alias("authors"),
        F.coalesce("publication_year", F.lit(0)).alias("year"), T.text_or_empty(F.col("primary_location.source.display_name")).alias("venue"), abstract.alias("abstract"), F.length(abstract).alias("abstract_length"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citations"), F.lit(source).alias("source"), F.coalesce(T.doi(F.col("doi")), F.lit("")).alias("doi"),
        F.coalesce(location_arxiv_id(F.col("primary_location"), F.col("locations")), F.lit("")).alias("arxiv_id"), F.coalesce("open_access.oa_status", F.lit("unknown")).alias("oa_status"),
        T.text_or_empty(F.col("open_access.oa_url")).alias("pdf_url"), T.text_or_empty(F.col("primary_location.landing_page_url")).alias("url"), F.monotonically_increasing_id().alias("pos"),
    )
    return out.where(F.length(F.trim("abstract")) > 0)


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a folder of JSON lists, in order of file name and place in the file, with ``seed_pos``.

    The seeds are one small dimension; a missing id, name or level is an error.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("_file"))
    kind = ArrayType(StructType.fromDDL(model.SEED))
    rows = files.select("_file", F.posexplode(F.from_json("value", kind, {"mode": "FAILFAST"})).alias("_i", "_s")).select("_file", "_i", "_s.*")
    whole = F.col("node_id").isNotNull() & F.col("name").isNotNull() & F.col("level").isNotNull()
    rows = rows.withColumn("node_id", F.when(whole, F.col("node_id")).otherwise(F.raise_error(F.lit("a seed lacks node_id, name or level"))))
    from pyspark.sql import Window as W

    return rows.withColumn("seed_pos", F.row_number().over(W.orderBy("_file", "_i"))).drop("_file", "_i")


def markdown_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(file, node_id, name, level, category, body) of Markdown seeds with a front matter."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file")).where(F.endswith("file", F.lit(".md")))
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1)
    of = lambda k: F.nullif(F.regexp_extract(front, rf"(?m)^{k}:\s*[\"']?(.*?)[\"']?\s*$", 1), F.lit(""))
    return rows.select("file", of("node_id").alias("node_id"), of("name").alias("name"), of("level").try_cast("int").alias("level"), of("category").alias("category"), F.trim(F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?", "")).alias("body"))


def prompt(text: str) -> dict[str, str]:
    """Sections of a prompt template by their second-level headings, lowered; templates are short and read on the driver."""
    parts = re.split(r"(?m)^##\s+(.+?)\s*$", text)
    return {"": parts[0].strip()} | {k.strip().lower(): v.strip() for k, v in zip(parts[1::2], parts[2::2], strict=True)}
