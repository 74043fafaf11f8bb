"""How a language's sources differ in their words: exact probabilities, the most raised terms, and distances of sources.

Counting is one pass: every task counts the terms of its own texts by language and
source, so what is shuffled is counts.  Each (lang, source) group and each lang gives every
kept term t of the lang p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), in
decimals without rounding.

Most raised terms (``terms``): a group's terms lie in buckets of like counts.  A bucket's
largest count and its smallest count in the lang bound p - q from above, its smallest
and largest from below.  What the lower bounds already promise k terms is a floor; only
buckets whose upper bound reaches it are dealt out, and within a group they are
evaluated best bound first, until the bound of all unseen ones is strictly below the
k-th value.  A group's live terms are split by a salt, so none fills a task.

Distances (``pairs``): for terms that neither source has, and for those that only one has,
the sum of |p - q| follows from each source's own counts; only terms that both have are
met, in postings (term to sources), whose sums by pair of sources are kept in
matrices of 256 x 256 sources and leave a task as sums.

Defined results: null text, lang and source are empty; every row is a document of its
own, repeated or not; a source without kept terms still has its distances; a lang
without kept terms has distances 0; a lang with one source has none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import forget, stored
from ._words import Words, groups, merged

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of texts that a task counts at once; one longer text is counted alone.
COUNT_BYTES = 24 << 20
#: Sources to a side of a matrix of sums, and matrices that a task holds.
SIDE, MATRICES = 256, 32
#: Pairs of a posting's sources that a task looks at in one go.
MEETINGS = 1 << 21
#: Live terms of a group to a salt.
SALT_ROWS = 50_000

#: Every byte that is no ASCII letter and no part of a character beyond ASCII ends a term.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _folded(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and all that parts terms made a space, byte by byte."""
    texts = pa.concat_arrays([texts])  # without an offset
    _, offsets, data = texts.buffers()
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD)))


def counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n occurrences, df documents)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merged(batches, COUNT_BYTES):
            for part, texts in groups(batch, most=2 * COUNT_BYTES):
                words = Words(_folded(texts))
                size = len(words.vocab)
                if not size:
                    continue
                names, of = {}, np.empty(part.num_rows, np.int64)
                for i, (a, b) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    of[i] = names.setdefault((a, b), len(names))
                doc = words.doc_of()
                # each document's distinct terms with their counts, then the same by group
                pair, n = np.unique(doc * size + words.codes, return_counts=True)
                place, inverse = np.unique(of[pair // size] * size + pair % size, return_inverse=True)
                labels = list(names)
                at = pa.array(place // size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in labels], pa.string()).take(at), pa.array([x[1] for x in labels], pa.string()).take(at), words.vocab.take(pa.array(place % size)).cast(pa.string()),
                        pa.array(np.bincount(inverse.ravel(), n, len(place)).astype(np.int64)), pa.array(np.bincount(inverse.ravel(), minlength=len(place)).astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "df"],
                )

    found = rows.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _p(count: Column, total: Column, terms: Column) -> Column:
    """A probability in units of 1 / SCALE, exactly."""
    big = lambda c: c.cast("decimal(20,0)")
    over = (big(count) + F.lit(PRIOR)).cast("decimal(21,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = big(total) + big(terms) * F.lit(PRIOR).cast("decimal(1,0)")
    return F.call_function("div", over, under) + 1


def _bucket(n: Column) -> Column:
    """A count with all but its four leading bits cleared."""
    low = F.greatest(F.length(F.bin(n)) - 4, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n, low), low)


class Audit:
    """The kept terms of some documents, with the totals that make probabilities of them; tables in the shared folder."""

    def __init__(self, docs: DataFrame, *, least: int = LEAST_DOCS, text: str = "text", lang: str = "lang", source: str = "source"):
        every = stored(counts(docs, text=text, lang=lang, source=source), "term-counts")
        kept = every.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df")
        #: (lang, source, term, n, n_lang)
        self.terms = stored(every.select("lang", "source", "term", "n").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "kept-terms")
        forget(every)
        langs = self.terms.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
        own = self.terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("m"))
        named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
        found = named.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "m", "v", "lang_total"])
        #: (lang, source, total, m own terms, v terms of the lang, lang_total, i place among the lang's sources)
        self.groups = stored(found.withColumn("i", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long")), "term-groups")

    def raised(self, k: int = TOP) -> DataFrame:
        """(lang, source, term, value = p - q > 0, rank): each group's k most raised terms, ties in order of the term."""
        p, q = _p(F.col("n"), F.col("total"), F.col("v")), _p(F.col("n_lang"), F.col("lang_total"), F.col("v"))
        at = self.groups.select("lang", "source", "total", "v", "lang_total")
        buckets = self.terms.groupBy("lang", "source", _bucket(F.col("n")).alias("bucket")).agg(
            F.count("*").alias("size"), F.max("n").alias("n_most"), F.min("n").alias("n_least"), F.min("n_lang").alias("l_least"), F.max("n_lang").alias("l_most")
        )
        bound = lambda n, of: _p(F.col(n), F.col("total"), F.col("v")) - _p(F.col(of), F.col("lang_total"), F.col("v"))
        buckets = buckets.join(at, ["lang", "source"]).select("lang", "source", "bucket", "size", bound("n_most", "l_least").alias("upper"), bound("n_least", "l_most").alias("lower"))
        best = W.partitionBy("lang", "source").orderBy(F.desc("lower")).rowsBetween(W.unboundedPreceding, 0)
        promised = buckets.withColumn("so_far", F.sum("size").over(best)).groupBy("lang", "source").agg(F.max(F.when(F.col("so_far") >= k, F.col("lower"))).alias("floor"))
        live = buckets.join(promised, ["lang", "source"]).where(F.col("upper") >= F.greatest(F.coalesce("floor", F.lit(1)), F.lit(1)))
        salts = F.ceil(F.sum("size").over(W.partitionBy("lang", "source")) / SALT_ROWS)
        live = live.withColumn("salts", salts).select("lang", "source", "bucket", "upper", "salts")
        dealt = self.terms.withColumn("bucket", _bucket(F.col("n"))).join(live, ["lang", "source", "bucket"]).join(at, ["lang", "source"])
        rows = dealt.select("lang", "source", F.pmod(F.xxhash64("term"), F.col("salts")).alias("salt"), "upper", "term", p.alias("p"), q.alias("q"))
        key = ["lang", "source", "salt"]
        found = rows.repartition(*key).sortWithinPartitions(*key, F.desc("upper")).mapInArrow(_best_first(k), "lang string, source string, term string, value long")
        place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    def distances(self) -> DataFrame:
        """(lang, source, other, value): the sum of |p - q| over the lang's kept terms, for every two sources of a lang."""
        none = _p(F.lit(0), F.col("total"), F.col("v"))
        g = self.groups.withColumn("p0", F.when(F.col("v") > 0, none).otherwise(F.lit(0)))
        terms = self.terms.join(g.select("lang", "source", "i", "total", "v", "p0"), ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("total"), F.col("v")))
        posting = F.collect_list(F.struct("i", "p", "p0"))
        both = terms.groupBy("lang", "term").agg(posting.alias("s")).where(F.size("s") > 1).select("lang", F.col("s.i").alias("i"), F.col("s.p").alias("p"), F.col("s.p0").alias("p0"))
        met = both.mapInArrow(_meetings, "lang string, a long, b long, part long").groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
        # a source's terms against what another gives a term that it lacks: above it but for few counts
        p0s = g.groupBy("lang").agg(F.max("p0").alias("p0_most"))
        low = terms.groupBy("lang", "i", "p").agg(F.count("*").alias("n")).join(p0s, "lang").where("p < p0_most").select("lang", F.col("i").alias("a"), "p", "n")
        above = g.select("lang", F.col("i").alias("b"), F.col("p0").alias("b0"))
        under = low.join(above, "lang").where(F.col("p") < F.col("b0")).groupBy("lang", "a", "b").agg(F.sum(2 * F.col("n") * (F.col("b0") - F.col("p"))).alias("under"))
        sums = terms.groupBy("lang", "source").agg(F.sum("p").alias("sum_p"))
        g = g.join(sums, ["lang", "source"], "left").fillna(0, ["sum_p"])
        side = lambda x: g.select("lang", F.col("i").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("source", "m", "p0", "sum_p")], *(["v"] if x == "a" else []))
        pairs = side("a").join(side("b"), "lang").where("a <> b")
        for name, one, two in (("under_a", "a", "b"), ("under_b", "b", "a")):
            pairs = pairs.join(under.select("lang", F.col("a").alias(one), F.col("b").alias(two), F.col("under").alias(name)), ["lang", "a", "b"], "left")
        twice = met.withColumn("ab", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).select("lang", "ab.a", "ab.b", "part")
        pairs = pairs.join(twice, ["lang", "a", "b"], "left").fillna(0, ["under_a", "under_b", "part"])
        apart = F.abs(F.col("a_p0") - F.col("b_p0"))
        alone = lambda x, y: F.col(f"{x}_sum_p") - F.col(f"{x}_m") * F.col(f"{y}_p0") + F.col(f"under_{x}") - F.col(f"{x}_m") * apart
        value = F.col("v") * apart + alone("a", "b") + alone("b", "a") + F.col("part")
        return pairs.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("other"), value.alias("value"))

    def report(self, k: int = TOP) -> DataFrame:
        """(lang, source, part, item, value, rank): distances of all sources, and the k most raised terms."""
        terms = self.raised(k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
        pairs = self.distances().select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
        place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return pairs.withColumn("rank", place).unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _best_first(k: int):
    """Rows in order of (group, salt) and falling bound to each one's k best, without a look at what the bounds rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, done = None, [], False

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(best), pa.string()), pa.array([now[1]] * len(best), pa.string()), pa.array([b[2] for b in best], pa.string()), pa.array([b[0] for b in best], pa.int64())], names=["lang", "source", "term", "value"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = [batch.column(i) for i in range(3)]
            edge = np.zeros(n, bool)
            for c in names:
                edge[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            upper = batch.column(3).to_numpy()
            # within a group and salt, one bucket after the other
            cuts = np.flatnonzero(edge | np.concatenate([[True], upper[1:] != upper[:-1]])).tolist()
            value = batch.column(5).to_numpy() - batch.column(6).to_numpy()
            for at, to in zip(cuts, [*cuts[1:], n], strict=True):
                key = tuple(c[at].as_py() for c in names)
                if key != now:
                    if best:
                        yield out()
                    now, best, done = key, [], False
                done = done or (len(best) == k and int(upper[at]) < best[-1][0])
                if done:
                    continue  # all that is unseen is strictly below the k-th value
                rows = at + np.flatnonzero(value[at:to] >= max(1, best[-1][0] if len(best) == k else 1))
                if len(rows):
                    terms = batch.column(4).take(pa.array(rows)).to_pylist()
                    met = [(int(v), t) for v, t in zip(value[rows].tolist(), terms, strict=True)]
                    best = heapq.nsmallest(k, [*best, *((v, t.encode(), t) for v, t in met)], key=lambda b: (-b[0], b[1]))
        if best:
            yield out()

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (lang, sources, p, p0) to what their pairs of sources (a < b) add to a sum that takes both as without the term."""
    held: dict[tuple[str, int, int], np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, x, y), m in held.items():
            a, b = np.nonzero(m)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + x * SIDE), pa.array(b + y * SIDE), pa.array(m[a, b])], names=["lang", "a", "b", "part"])
        held.clear()

    def ends(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        total, at = np.cumsum(sizes.astype(np.float64) ** 2), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MEETINGS, side="right")))
            yield at, to
            at = to

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            own = batch.filter(pc.equal(langs.indices, code))
            sizes = pc.list_value_length(own.column(1)).to_numpy()
            offset = np.concatenate([[0], np.cumsum(sizes)])
            i, p, p0 = (own.column(c).flatten().to_numpy() for c in (1, 2, 3))
            for at, to in ends(sizes):
                for first, second in _pairs(sizes[at:to], offset[at:to]):
                    a, b = np.where(i[first] < i[second], first, second), np.where(i[first] < i[second], second, first)
                    part = np.abs(p[a] - p[b]) - np.abs(p[a] - p0[b]) - np.abs(p0[a] - p[b]) + np.abs(p0[a] - p0[b])
                    block = (i[a] // SIDE) << 32 | (i[b] // SIDE)
                    for both in np.unique(block).tolist():
                        here = block == both
                        m = held.setdefault((lang, both >> 32, both & 0xFFFFFFFF), np.zeros((SIDE, SIDE), np.int64))
                        np.add.at(m, (i[a][here] % SIDE, i[b][here] % SIDE), part[here])
                    if len(held) > MATRICES:
                        yield from out()
    yield from out()


def _pairs(sizes: np.ndarray, offset: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of every two entries of each list, about MEETINGS of them at a time."""
    entry = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[entry] - place - 1
    total, at = np.cumsum(left), 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MEETINGS, side="right")))
        some = left[at:to]
        first = np.repeat(offset[entry[at:to]] + place[at:to], some)
        step = np.arange(len(first)) - np.repeat(np.cumsum(some) - some, some) + 1
        yield first, first + step
        at = to


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
e AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM e GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS lang_total FROM kept GROUP BY lang),
own AS (SELECT e.lang, e.source, e.term, count(*) AS n FROM e JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.lang_total, 0) AS lang_total, coalesce((SELECT sum(n) FROM own o WHERE o.lang = g.lang AND o.source = g.source), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l USING (lang)),
every AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 5)) // (g.total + 5 * g.v) AS p, 1 + (1000000000::HUGEINT * (k.n_lang + 5)) // (g.lang_total + 5 * g.v) AS q
    FROM groups g JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
both_ AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM every x JOIN every y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM both_
    UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM every WHERE n > 0 AND p > q) WHERE rank <= 50)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
"""
