"""Benchmark decontamination: BM25 over test items with block-max WAND.

Test items are the index, training passages the queries.  A document's normalised
tokens are cut into cells of ``STRIDE``; a passage is two neighbouring cells, so
every run of ``STRIDE`` + 1 tokens lies whole in one.  Impacts are divided by the
item's own threshold (``THETA`` of the score it has against itself), so that one
threshold, 1, serves all items.

First the block bounds are summed for whole batches of passages at once (gather and
segmented sum over the block-max table); a passage none of whose blocks can reach
the threshold is done.  The others walk the postings document at a time by
block-max WAND: the pivot comes from the terms' overall bounds, is confirmed by the
bounds of the blocks it falls in, or skipped past the nearest block border.

Everything above the threshold is retrieved, then verified: 5-word shingles of the
question (all but the last sentence) and of the answer (the last sentence) must
stand in the document around the passage.

Items are taken in blocks of at most ``ITEMS`` index units, of which ``PASS`` are broadcast
to one pass over the documents, which are cut into words once for all of them, so the
index held in memory is bounded at any size of the test set.  Document frequency and mean length are those of all units, whatever the block.

Defined results: null or wordless items match nothing; null and empty texts have no
passages.  Equal items are reported each under its own id.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored
from ._words import Words, groups

K1, B = 1.2, 0.75
#: Share of an item's own score from which a passage is retrieved.
THETA = 0.6
SHINGLE, OVERLAP, ANSWER_OVERLAP = 5, 0.8, 0.5
STRIDE = 64
BLOCK = 8  # postings to a block of WAND
ITEMS = 4096  # index units to a block
PASS = 8  # blocks that one pass over the documents is matched with
_BOUNDS = 64  # columns of the table of batch bounds
#: Documents to match in one pass, in bytes of text.
_GROUP = 2 << 20
_NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def normal(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(texts), _NOT_WORD, " ")


def tokens(text: str | None) -> list[str]:
    return normal(pa.array([text or ""], pa.string()))[0].as_py().split()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Tokens of all sentences but the last, and of the last; the last fifth if there is one sentence."""
    pieces = [t for t in (tokens(x) for x in re.split(r"(?<=[.?!])\s+|\n+", text)) if t]
    if len(pieces) > 1:
        return [w for p in pieces[:-1] for w in p], pieces[-1]
    words = pieces[0] if pieces else []
    cut = len(words) - max(1, len(words) // 5)
    return words[:cut], words[cut:]


@dataclasses.dataclass
class Item:
    item_id: int
    question: list[str]
    answer: list[str]


def index_units(item: Item) -> list[list[str]]:
    """The words of an item, or of each ``STRIDE`` tokens of a longer one."""
    words = item.question + item.answer
    starts = range(0, max(1, len(words) - STRIDE + 1), STRIDE) if len(words) > STRIDE else (0,)
    return [words[s : s + STRIDE] for s in {*starts, max(0, len(words) - STRIDE)}]


@dataclasses.dataclass
class Statistics:
    """Of all units: their number, their mean length and the document frequency of terms."""

    n: int
    mean: float
    df: dict[str, int]


class Index:
    """Postings by term over index units (an item, or ``STRIDE`` tokens of a longer one), scored by ``over`` or by their own statistics."""

    def __init__(self, items: list[Item], over: Statistics | None = None):
        self.items = items
        units: list[list[str]] = []
        self.owner: list[int] = []
        for i, item in enumerate(items):
            for unit in index_units(item):
                units.append(unit)
                self.owner.append(i)
        n = len(units)
        counts = [Counter(u) for u in units]
        if over is None:
            over = Statistics(n, sum(map(len, units)) / n if n else 1.0, Counter(t for c in counts for t in c))
        mean, df = over.mean, {t: over.df[t] for c in counts for t in c}
        self.terms = {t: i for i, t in enumerate(sorted(df))}
        self.vocab = pa.array(list(self.terms), pa.string())
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        width = max(1, -(-n // _BOUNDS))
        self.bounds = np.zeros((len(self.terms), max(1, -(-n // width))), np.float32)
        for u, c in enumerate(counts):
            impact = {}
            for t, f in c.items():
                idf = math.log(1 + (over.n - df[t] + 0.5) / (df[t] + 0.5))
                impact[t] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(units[u]) / mean))
            own = THETA * sum(impact.values())
            for t in sorted(impact):
                x = impact[t] / own
                postings[self.terms[t]].append((u, x))
                self.bounds[self.terms[t], u // width] = max(self.bounds[self.terms[t], u // width], x)
        self.units = {t: [u for u, _ in p] for t, p in postings.items()}
        self.impacts = {t: [x for _, x in p] for t, p in postings.items()}
        self.most = {t: max(x) for t, x in self.impacts.items()}
        self.last = {t: [p[min(k + BLOCK, len(p)) - 1] for k in range(0, len(p), BLOCK)] for t, p in self.units.items()}
        self.block_most = {t: [max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for t, x in self.impacts.items()}

    def candidates(self, cells: np.ndarray, codes: np.ndarray, n_cells: int) -> np.ndarray:
        """Which passages [cell, cell + 1] some block's bounds let reach the threshold."""
        sums = np.zeros((n_cells + 1, self.bounds.shape[1]), np.float32)
        if len(codes):
            first = np.flatnonzero(np.diff(cells, prepend=-1))
            sums[cells[first]] = np.add.reduceat(self.bounds[codes], first, axis=0)
        return (sums[:-1] + sums[1:] >= 1 - 1e-4).any(axis=1)

    def search(self, terms: list[int], threshold: float = 1 - 1e-6) -> list[tuple[int, float]]:
        """All units that score at least ``threshold`` for a set of terms, by block-max WAND."""
        end = 1 << 60
        lists = [[self.units[t][0], t, 0] for t in terms]  # current unit, term, position
        out = []

        def advance(x: list, to: int) -> None:
            """Move to the first posting not before unit ``to``, block by block."""
            units, last = self.units[x[1]], self.last[x[1]]
            k = x[2] // BLOCK
            while k < len(last) and last[k] < to:
                k += 1
            at = max(x[2], k * BLOCK)
            while at < len(units) and units[at] < to:
                at += 1
            x[2] = at
            x[0] = units[at] if at < len(units) else end

        while True:
            lists.sort()
            total, pivot = 0.0, -1
            for i, x in enumerate(lists):
                if x[0] == end:
                    break
                total += self.most[x[1]]
                if total >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return out
            unit = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == unit:
                pivot += 1
            bound, border = 0.0, end
            for x in lists[: pivot + 1]:
                last = self.last[x[1]]
                k = x[2] // BLOCK
                while k < len(last) and last[k] < unit:
                    k += 1
                if k < len(last):
                    bound += self.block_most[x[1]][k]
                    border = min(border, last[k] + 1)
            if bound < threshold:
                if pivot + 1 < len(lists):
                    border = min(border, lists[pivot + 1][0])
                for x in lists[: pivot + 1]:
                    if x[0] < border:
                        advance(x, max(border, unit + 1) if border <= unit else border)
                continue
            score = 0.0
            for x in lists[: pivot + 1]:
                if x[0] < unit:
                    advance(x, unit)
                if x[0] == unit:
                    score += self.impacts[x[1]][x[2]]
            if score >= threshold:
                out.append((unit, score))
            for x in lists:
                if x[0] == unit:
                    advance(x, unit + 1)


def _overlap(part: list[str], near: list[str]) -> float:
    """Share of the part's shingles that stand in ``near``."""
    if not part:
        return 1.0
    k = min(SHINGLE, len(part))
    there = {tuple(near[i : i + k]) for i in range(len(near) - k + 1)}
    own = [tuple(part[i : i + k]) for i in range(len(part) - k + 1)]
    return sum(s in there for s in own) / len(own)


def matches(index: Index, words: Words) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap) of all that is verified, for the words of ``normal`` texts."""
    if not len(words.codes) or not index.items:
        return
    term = pc.index_in(words.vocab, index.vocab).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[words.codes]
    per_text = -(-words.counts // STRIDE)
    first_cell = np.concatenate([[0], np.cumsum(per_text + 1)])  # one empty cell between texts
    doc = words.doc_of()
    cell = first_cell[doc] + (np.arange(len(doc)) - words.offsets[doc]) // STRIDE
    known = term >= 0
    key = np.unique(cell[known] * len(index.terms) + term[known])
    cells, codes = key // len(index.terms), key % len(index.terms)
    n_cells = int(first_cell[-1])
    live = index.candidates(cells, codes, n_cells)
    live[first_cell[1:] - 1] = False  # the empty cell after a text starts no passage
    hot = np.flatnonzero(live)
    border = np.searchsorted(cells, np.arange(n_cells + 2))
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    vocab = None
    for c in hot.tolist():
        terms = np.unique(codes[border[c] : border[c + 2]])
        if index.bounds[terms].sum(axis=0).max() < 1 - 1e-4:
            continue  # terms of both cells were counted twice above
        units = index.search(terms.tolist())
        if not units:
            continue
        d = int(np.searchsorted(first_cell, c, side="right")) - 1
        if vocab is None:
            vocab = words.vocab.to_pylist()
        for u, score in units:
            i = index.owner[u]
            item = index.items[i]
            size = len(item.question) + len(item.answer)
            begin = int(words.offsets[d]) + (c - int(first_cell[d])) * STRIDE
            near = [vocab[x] for x in words.codes[max(int(words.offsets[d]), begin - size) : min(int(words.offsets[d + 1]), begin + 2 * STRIDE + size)].tolist()]
            whole, q, a = _overlap(item.question + item.answer, near), _overlap(item.question, near), _overlap(item.answer, near)
            if whole >= OVERLAP and q >= OVERLAP and a >= ANSWER_OVERLAP:
                found[d, i] = max(found.get((d, i), (0.0, 0.0, 0.0)), (score * THETA, q, a))
    for (d, i), (score, q, a) in sorted(found.items()):
        yield d, i, score, q, a


def _counts(items: DataFrame) -> DataFrame:
    """(term, n, words): document frequency of each term over all units; the null term has their number and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df: Counter[str] = Counter()
            n = size = 0
            for text in batch.column(0).to_pylist():
                question, answer = question_answer(text or "")
                if question or answer:
                    for unit in index_units(Item(0, question, answer)):
                        df.update(set(unit))
                        n, size = n + 1, size + len(unit)
            yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.string()), pa.array([n, *df.values()], pa.int64()), pa.array([size, *([0] * len(df))], pa.int64())], names=["term", "n", "words"])

    return items.select("text").mapInArrow(run, "term string, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def indexes(items: DataFrame, most: int = ITEMS) -> Iterator[Index]:
    """The index in blocks; items come in order of id, so no more than two blocks are held.

    Scores do not depend on the blocks: where there are several, statistics are counted over
    all units once, and the driver gets those of a block's own terms.
    """
    counts = total = None
    for held, alone in _blocks(items, most):
        if alone:
            yield Index(held)
            return
        if counts is None:
            counts = stored(_counts(items), "item-terms")
            total = counts.where("term IS NULL").first()
        terms = sorted({w for item in held for w in item.question + item.answer})
        own = counts.join(items.sparkSession.createDataFrame([(t,) for t in terms], "term string"), "term").collect()
        yield Index(held, Statistics(total["n"], total["words"] / total["n"], {r["term"]: r["n"] for r in own}))


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[list[Item], bool]]:
    """Blocks of items of about ``most`` units, and whether it is the only one."""
    before: list[Item] | None = None
    several = False
    held: list[Item] = []
    size = 0
    for row in items.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        question, answer = question_answer(row[1] or "")
        if not question and not answer:
            continue
        if size >= most:
            if before is not None:
                several = True
                yield before, False
            before, held, size = held, [], 0
        held.append(Item(row[0], question, answer))
        size += 1 + (len(question) + len(answer)) // STRIDE
    if before is not None:
        several = True
        yield before, False
    if held:
        yield held, not several


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _passes(spark: SparkSession, items: DataFrame) -> Iterator[list[Broadcast]]:
    """The blocks of the index, broadcast, in lists of at most ``PASS``: each list is one pass over the documents."""
    held: list[Broadcast] = []
    for index in indexes(items):
        held.append(spark.sparkContext.broadcast(index))
        if len(held) == PASS:
            yield held
            held = []
    if held:
        yield held


def find(docs: DataFrame, items: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each test item in each document; ``score`` is its share of the item's own score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], FOUND)
    for shared in _passes(spark, items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in groups(batch, most=_GROUP):
                    ids, words = part.column(0).to_pylist(), Words(normal(texts))
                    for index in (s.value for s in shared):
                        got = list(matches(index, words))
                        if got:
                            d, i, s, q, a = zip(*got, strict=True)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([ids[x] for x in d], pa.int64()), pa.array([index.items[x].item_id for x in i], pa.int64()), *[pa.array(x, pa.float64()) for x in (s, q, a)]], names=[x.split()[0] for x in FOUND.split(", ")]
                            )

        out = out.union(rows.mapInArrow(run, FOUND))
    return out


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` without those that hold a test item; no row moves between tasks."""
    for shared in _passes(docs.sparkSession, items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in groups(batch, text, _GROUP):
                    keep, words = np.ones(part.num_rows, bool), Words(normal(texts))
                    for s in shared:
                        keep[[m[0] for m in matches(s.value, words)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
