"""The boundary to language models: one replaceable interface, and batch calls over DataFrames.

An adapter turns (system, user) prompts into text.  No client of a provider is here:
``Noop`` refuses, ``Replay`` answers from recorded responses, so every query can be
repeated; a live client has the same one method.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies
from ..functions import text as T
from . import reports, screening, seeds

ATTEMPTS = 3
STRONGER = "\n\nReturn only one valid JSON object, with no other text."


class Adapter(Protocol):
    def complete_text(self, system: str, user: str) -> str: ...


class Noop:
    """Stands for no model: every row is marked as skipped."""

    def complete_text(self, system: str, user: str) -> str:
        return json.dumps({"skipped": True, "reason": "no language model"})


def prompt_key(system: str, user: str) -> str:
    return hashlib.sha256(f"{system}\x00{user}".encode()).hexdigest()


class Replay:
    """Answers from recorded replies by the hash of the prompt; ``default`` for any other."""

    def __init__(self, recorded: dict[str, str], default: str | None = None):
        self.recorded, self.default = recorded, default

    def complete_text(self, system: str, user: str) -> str:
        found = self.recorded.get(prompt_key(system, user), self.default)
        if found is None:
            raise KeyError("no recorded reply")
        return found


def complete_json(adapter: Adapter, system: str, user: str) -> dict:
    """A JSON object from the model: asked again, in stronger words, up to ``ATTEMPTS`` times; else an error record."""
    raw = ""
    for i in range(ATTEMPTS):
        try:
            raw = adapter.complete_text(system, user + STRONGER * bool(i))
        except Exception as e:  # a call that fails is one row's error, not the job's
            return {"error": f"{type(e).__name__}: {e}"}
        for text in (raw, *re.findall(r"(?s)```(?:json)?\s*(.*?)```", raw), *re.findall(r"(?s)\{.*\}", raw)):
            try:
                found = json.loads(text)
            except ValueError:
                continue
            if isinstance(found, dict):
                return found
    return {"error": "no JSON in the reply", "raw": raw[:2000]}


def ask(rows: DataFrame, adapter: Adapter, system: str, user: Column, *, key: str = "paper_id", as_json: bool = True) -> DataFrame:
    """(key, reply, error): one call a row, in batches; the parallel calls are the partitions of ``rows``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, prompt in zip(batch[key], batch["_user"], strict=True):
                if as_json:
                    found = complete_json(adapter, system, prompt)
                    out.append((k, json.dumps(found, ensure_ascii=False), found.get("error")))
                else:
                    try:
                        out.append((k, adapter.complete_text(system, prompt), None))
                    except Exception as e:  # as above
                        out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "reply", "error"])

    asked = rows.select(key, user.alias("_user"))
    return asked.mapInPandas(run, asked.select(key).schema.add("reply", "string").add("error", "string"))


def relevance(papers: DataFrame, adapter: Adapter, topic: str, *, system: str, template: str, n: int = 10) -> DataFrame:
    """The n papers that the model finds relevant, from title and the first 200 characters of the abstract."""
    user = T.filled(template, {"topic": F.lit(topic), "title": F.col("title"), "abstract_snippet": F.substring("abstract", 1, 200)})
    said = ask(papers, adapter, system, user, as_json=False).select("paper_id", replies.relevance(F.col("reply")).alias("_r"))
    scored = papers.join(said, "paper_id").withColumn("relevance", F.coalesce(F.col("_r.score"), F.lit(0))).withColumn("confidence", F.coalesce(F.col("_r.confidence"), F.lit(0.0))).drop("_r")
    return screening.keep_relevant(scored, n)


def reviewed(papers: DataFrame, adapter: Adapter, *, system: str, template: str, gate: float = 3.0) -> DataFrame:
    """(paper_id, scores, mean_score, llm_passed, error) of a review by five scores."""
    user = T.filled(template, {"title": F.col("title"), "abstract": F.col("abstract")})
    said = ask(papers, adapter, system, user)
    scores = replies.review_scores(F.col("reply"))
    given = F.get_json_object("reply", "$.mean_score").try_cast("double")
    rows = said.withColumn("scores", scores).withColumn("mean_score", F.when(F.col("error").isNull(), replies.mean_score(F.col("scores"), given)))
    said_so = F.get_json_object("reply", "$.passed").try_cast("boolean")
    return rows.select("paper_id", "scores", "mean_score", F.coalesce(said_so, F.col("mean_score") >= gate, F.lit(False)).alias("llm_passed"), "error")


def structures(papers: DataFrame, adapter: Adapter, *, system: str, template: str) -> DataFrame:
    """(paper_id, knowledge_level, knowledge_level_confidence, structure_template, error) as a model extracts them.

    Lists that come as text are cut at arrows or commas.
    """
    user = T.filled(template, {"title": F.col("title"), "abstract": F.col("abstract")})
    said = ask(papers, adapter, system, user)
    of = lambda k: F.get_json_object("reply", f"$.structure_template.{k}")

    def listed(k: str, arrows: bool = False) -> Column:
        return F.when(F.startswith(of(k), F.lit("[")), F.from_json(of(k), "array<string>")).when(of(k).isNotNull(), replies.listed(of(k), arrows))

    pattern = F.when(F.startswith(of("abstract_pattern"), F.lit("[")), F.array_join(F.from_json(of("abstract_pattern"), "array<string>"), " → ")).otherwise(of("abstract_pattern"))
    template_ = F.struct(
        listed("signal_chain", True).alias("signal_chain"), of("control_architecture").alias("control_architecture"), of("optimization_target").alias("optimization_target"), listed("constraint_type").alias("constraint_type"),
        pattern.alias("abstract_pattern"), of("mathematical_core").alias("mathematical_core"), of("domain_abstraction").alias("domain_abstraction"),
    )
    return said.select(
        "paper_id", F.from_json(F.get_json_object("reply", "$.knowledge_level"), "array<string>").alias("knowledge_level"), replies.percent(F.get_json_object("reply", "$.knowledge_level_confidence")).alias("knowledge_level_confidence"),
        F.when(F.get_json_object("reply", "$.structure_template").isNotNull(), template_).alias("structure_template"), "error",
    )


def further_queries(papers: DataFrame, n: int) -> DataFrame:
    """(phase, query) without a model: two queries from each title's first telling words, each once, n a phase.

    Phase C looks for limits, phase D for what came after.
    """
    terms = T.search_terms(F.col("title"))
    rows = papers.select("pos", F.explode(F.array(F.struct(F.lit("C").alias("phase"), F.concat(terms, F.lit(" limitations convergence stability")).alias("query")), F.struct(F.lit("D").alias("phase"), F.concat(terms, F.lit(" recent advances improvement 2024 2025")).alias("query")))).alias("q")).select("pos", "q.*")
    from pyspark.sql import Window as W

    once = rows.groupBy("phase", "query").agg(F.min("pos").alias("pos"))
    return once.withColumn("_n", F.row_number().over(W.partitionBy("phase").orderBy("pos"))).where(F.col("_n") <= n).drop("_n")


def conflicts(papers: DataFrame, known: DataFrame, seed_nodes: DataFrame, adapter: Adapter, *, system: str, template: str, top: int = 15) -> DataFrame:
    """(paper_id, reply, unexplainability, conditions, changes, error): one prompt a paper with what it is held against."""
    near = seeds.retrieve(papers, known, top).groupBy("new_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "paper_id", "relevance")))).alias("near"))
    names = seed_nodes.orderBy("id").limit(20).agg(F.concat_ws(", ", F.collect_list("title")).alias("_seeds"))
    rows = papers.join(near.withColumnRenamed("new_id", "paper_id"), "paper_id", "left").join(F.broadcast(names))
    user = T.filled(template, {"title": F.col("title"), "abstract": F.col("abstract"), "seeds": F.col("_seeds"), "papers": F.col("near")})
    said = ask(rows, adapter, system, user)
    of = lambda k: F.get_json_object("reply", f"$.conflict_assessment.{k}")
    held = F.map_from_arrays(F.array(*map(F.lit, ("dissatisfaction", "intelligibility", "plausibility", "fruitfulness"))), F.array(*[F.coalesce(of(f"conceptual_change_conditions.{c}.value").try_cast("boolean"), F.lit(False)) for c in ("dissatisfaction", "intelligibility", "plausibility", "fruitfulness")]))
    changes = F.transform(F.coalesce(F.from_json(F.get_json_object("reply", "$.changes"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>")), lambda m: F.try_element_at(m, F.lit("type")))
    return said.select("paper_id", "reply", replies.percent(of("unexplainability_score")).alias("unexplainability"), held.alias("conditions"), changes.alias("changes"), "error")


def review_text(papers: DataFrame, adapter: Adapter | None, *, system: str = "", template: str = "", n: int = 10) -> str:
    """A review of the n best papers; from their figures if there is no model or it fails.  It is one text, made on the driver from n rows."""
    best = reports.best_first(papers, n).select("paper_id", "title", "year", "best").collect()
    if adapter is not None and not isinstance(adapter, Noop):
        listing = "\n".join(f"- {r['title']} ({r['year']})" for r in best)
        try:
            return re.sub(r"(?s)\A```(?:markdown|md)?\n?(.*?)\n?```\Z", r"\1", adapter.complete_text(system, template.replace("{papers}", listing)).strip())
        except Exception:  # the table below needs no model
            pass
    years = ", ".join(f"{r['year']}: {r['n']}" for r in reports.by_year(papers).collect())
    lines = ["# Review", "", f"Papers by year: {years}", "", "| Rank | Paper | Year | Score |", "| --- | --- | --- | --- |"]
    return "\n".join(lines + [f"| {i} | {r['title']} | {r['year']} | {r['best'] or 0:.3f} |" for i, r in enumerate(best, 1)] + [""])


def translated(texts: DataFrame, adapter: Adapter | None, *, system: str = "", template: str = "{text}", mode: str = "generate") -> DataFrame:
    """(name, text) in another language, chunk by chunk of paragraphs; ``none`` copies."""
    if mode == "none" or adapter is None:
        return texts.select("name", "text")
    chunks = texts.select("name", F.posexplode(T.paragraphs(F.col("text"))).alias("i", "chunk")).withColumn("id", F.concat_ws("\x00", "name", F.col("i").cast("string")))
    said = ask(chunks, adapter, system, T.filled(template, {"text": F.col("chunk")}), key="id", as_json=False)
    whole = chunks.join(said, "id").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("reply", "chunk").alias("t")))).alias("c"))
    return whole.select("name", F.array_join(F.transform("c", lambda x: x["t"]), "\n\n").alias("text"))


def technical_terms(texts: DataFrame) -> DataFrame:
    """Distinct entries of the tags and keywords lists in front matters, for a glossary."""
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    lists = F.regexp_extract_all(front, F.lit(r"(?m)^(?:tags|keywords|knowledge_level):\s*\[(.*?)\]"), 1)
    words = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda w: F.trim(F.regexp_replace(w, "[\"']", "")))
    return texts.select(F.explode(words).alias("term")).where("term <> ''").distinct()
