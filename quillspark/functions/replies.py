"""Column functions that read what language models reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped, text_or_empty

#: Short and long names of the five review scores (fixed values).
SCORES = {"C1": "contribution", "C2": "correctness", "C3": "clarity", "C4": "connectedness", "L": "likelihood"}


def _field(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$.{name}")


def json_text(reply: Column) -> Column:
    """The JSON object in a reply: inside a fence, else between the outermost braces, else null."""
    t = text_or_empty(reply)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    valid = [F.when((c != "") & F.try_parse_json(c).isNotNull(), c) for c in (fenced, braces, stripped(t))]
    return F.coalesce(*valid)


def relevance(reply: Column) -> Column:
    """struct(score int, confidence double) of a relevance reply, by ever weaker readings; null if there is none.

    In order: the whole reply as JSON (1.0), its first innermost braces (0.9), its first braces up to the nearest end
    (0.8), its outermost braces (0.7), ``score: n`` in text (0.5), ``relevance ... n`` (0.5), a lone digit 1 to 5 (0.3).
    A confidence that the JSON gives itself is kept.
    """
    t = stripped(text_or_empty(reply))
    t = stripped(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?", ""), r"```$", ""))
    tries = []
    for pattern, confidence in ((r"(?s)^(\{.*\})$", 1.0), (r"(?s)(\{[^{}]*?\})", 0.9), (r"(?s)(\{.*?\})", 0.8), (r"(?s)(\{.*\})", 0.7)):
        found = F.regexp_extract(t, pattern, 1)
        score = _field(found, "score")
        given = F.coalesce(_field(found, "confidence").try_cast("double"), F.lit(confidence))
        tries.append(F.when((found != "") & score.isNotNull(), F.struct(score.try_cast("double").cast("int").alias("score"), given.alias("confidence"))))
    for pattern, confidence in ((r"(?i)[\"']?score[\"']?\s*[:=]\s*(\d+)", 0.5), (r"(?i)relevance[^\d]*(\d)", 0.5), (r"\b([1-5])\b", 0.3)):
        score = F.regexp_extract(t, pattern, 1).try_cast("int")
        tries.append(F.when(score.between(1, 5), F.struct(score.alias("score"), F.lit(confidence).alias("confidence"))))
    return F.coalesce(*tries)


def review_scores(json: Column) -> Column:
    """map(name, double) of the review scores in a reply's JSON, wrapped in ``scores`` or not, under short or long names."""
    pairs = []
    for short, long in SCORES.items():
        names = [p + n for p in ("scores.", "") for n in (long, short, short.lower())]
        value = F.coalesce(*[F.when(_field(json, n).isNotNull(), F.coalesce(_field(json, n).try_cast("double"), F.lit(0.0))) for n in names])
        pairs.append(F.struct(F.lit(long).alias("key"), value.alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def mean_score(scores: Column, given: Column | None = None) -> Column:
    """Mean of the positive scores at two places, unless a mean other than 0 is given; 0 without any."""
    positive = F.filter(F.map_values(scores), lambda v: v > 0)
    mean = F.when(F.size(positive) > 0, F.round(F.aggregate(positive, F.lit(0.0), lambda a, v: a + v) / F.size(positive), 2))
    return F.coalesce(F.nullif(given, F.lit(0.0)) if given is not None else F.lit(None).cast("double"), mean, F.lit(0.0))


def listed(value: Column, arrows: bool = False) -> Column:
    """A list that came as text: cut at arrows if there are any (and ``arrows``), else at commas."""
    parts = F.split(text_or_empty(value), ",")
    if arrows:
        parts = F.when(F.contains(value, F.lit("→")), F.split(value, "→")).otherwise(parts)
    return F.transform(parts, lambda x: F.trim(x))


def percent(value: Column) -> Column:
    """A share in [0, 1]; values over 1 count as percent, others than numbers as 0."""
    v = F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(v > 1, v / 100).otherwise(v)))


def lenient(value: Column, kind: str) -> Column:
    """JSON text as ``kind``; null where it is not that."""
    return F.from_json(value, kind, {"mode": "PERMISSIVE"})
