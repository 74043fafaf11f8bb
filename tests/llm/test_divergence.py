"""The divergence audit against plain counting: odd rows, ties, more sources than a matrix has sides, counts beyond 64 bits."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=30, top=50):
    found, docs, seen = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        seen.add((lang, source))
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in seen}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for x, s in seen if x == lang]
        whole = sum((found[lang, s] for s in sources), Counter())

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, by = p(whole), {s: p(found[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(by[s][t] - by[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(by[s][t] - q[t], t) for t in kept if found[lang, s][t] and by[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, i, v, r + 1) for r, (v, i) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def text(draw, n, words):
    return " ".join(draw.choice(words) for _ in range(n))


def rows_of(seed, n, sources, words):
    draw = random.Random(seed)
    return [(k, text(draw, draw.randrange(12), words), draw.choice(["en", "de", None]), draw.choice(sources)) for k in range(n)]


@pytest.mark.parametrize("least, top", [(30, 50), (2, 3), (10**6, 50)])
def test_report_is_plain_counting(spark, least, top):
    words = ["The", "the", "ÜBER", "über", "a1b", "x", "y", "zz", "日本", "don't", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = rows_of(1, 500, ["a", "b", "B", None, "é"], words)
    # ties, repeated rows, no text, nothing but what is no term, a lang of one source, a hot source of long texts
    rows += [(1, "tie tie", "en", "a")] * 40 + [(2, None, "en", "c"), (3, "", None, None), (4, "123 !?", "fr", "x"), (None, "solo " * 50, "es", "one")] + [(9, text(random.Random(5), 5000, words), "en", "hot")] * 3
    df = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("value", F.lit(2))
    assert got(divergence.Audit(df, least=least).report(top)) == plain(rows, least, top)


def test_empty(spark):
    assert divergence.Audit(spark.createDataFrame([], SCHEMA)).report().count() == 0


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SIDE", 4)
    monkeypatch.setattr(divergence, "MATRICES", 2)
    monkeypatch.setattr(divergence, "MEETINGS", 50)
    rows = rows_of(3, 400, [f"s{i}" for i in range(11)], [f"w{chr(97 + i)}" for i in range(15)])
    # matrices of 4 x 4 sources are sent to the tasks with the function, as its globals are
    postings = [(lang, i, p, p0) for lang, i, p, p0 in (("en", [3, 0, 9, 10, 5], [9, 4, 7, 1, 30], [1, 1, 2, 3, 1]), ("en", [9, 3], [5, 6], [2, 1]), ("de", [0, 1], [5, 2], [1, 1]))]
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in postings]), *(pa.array([x[k] for x in postings], pa.list_(pa.int64())) for k in (1, 2, 3))], names=["lang", "i", "p", "p0"])
    sums = Counter()
    for part in divergence._meetings(iter([batch])):
        for lang, a, b, v in zip(*(c.to_pylist() for c in part.columns), strict=True):
            sums[lang, a, b] += v
    want = Counter()
    for lang, i, p, p0 in postings:
        for x in range(len(i)):
            for y in range(len(i)):
                if i[x] < i[y]:
                    want[lang, i[x], i[y]] += abs(p[x] - p[y]) - abs(p[x] - p0[y]) - abs(p0[x] - p[y]) + abs(p0[x] - p0[y])
    assert {k: v for k, v in sums.items() if v} == {k: v for k, v in want.items() if v}
    assert got(divergence.Audit(spark.createDataFrame(rows, SCHEMA), least=5).report()) == plain(rows, 5)


def test_probabilities_beyond_64_bits(spark):
    n, total, v = 7 * 10**17, 9 * 10**18, 10**6
    got = spark.createDataFrame([(n, total, v)], "n long, t long, v long").select(divergence._p(F.col("n"), F.col("t"), F.col("v")).alias("p")).first()
    assert got.p == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_search_stops_at_the_bound():
    """A row whose bound is strictly below the k-th value is not evaluated; one that ties it is."""
    rows = [("en", "a", 0, 90, "x", 95, 5), ("en", "a", 0, 80, "y", 85, 5), ("en", "a", 0, 80, "w", 85, 5), ("en", "a", 0, 79, "late", 900, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(7)], names=["lang", "source", "salt", "upper", "term", "p", "q"])
    out = [t for b in divergence._best_first(2)(iter([batch])) for t in b.column(2).to_pylist()]
    assert out == ["x", "w"]
