"""Quality classifier: naive Bayes features under a support vector machine.

The features are n-gram indicators: words (1 and 2) and word shapes (1 to 3), a
shape being the word's runs of lower case, upper case, digits and other signs, and
``=`` for a word equal to the one before.  An indicator is scaled by the log ratio of
its smoothed shares in the two classes; each text's vector is brought to unit
length; and a linear model with hinge loss is fitted by dual coordinate descent.
Margins become scores by Platt's calibration on rows left out of the fit.

Defined results: null, empty and unknown texts have no indicators and get the score
of the bias; without labelled rows of both classes every score is 0.5.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import _labelled
from ._words import U64, Words, groups, mix, window_starts

#: Rows of each class that the model may be fitted on, and the longest row taken.
PER_CLASS, ROW_BYTES = 800, 60_000
TABLE = 1 << 20
THRESHOLD = 0.3
_SHAPE = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> U64(44)).astype(np.int64) & (TABLE - 1)


def indicators(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every n-gram occurrence."""
    doc = words.doc_of()
    wh = mix(words.hashes() ^ U64(11))
    vocab = words.vocab.to_pylist()
    shapes = np.fromiter((xxhash.xxh64_intdigest(_RUN.sub(rb"\1", w.encode("utf-8", "replace").translate(_SHAPE)), 1) for w in vocab), U64, len(vocab))[words.codes]
    same = np.zeros(len(doc), bool)
    same[1:] = (words.codes[1:] == words.codes[:-1]) & (doc[1:] == doc[:-1])
    shapes[same] = U64(0x5EED)
    docs, slots = [doc, doc], [_slots(wh), _slots(mix(shapes))]
    for n, values, salt in ((2, wh, 3), (2, shapes, 5), (3, shapes, 7)):
        at = window_starts(words.offsets, n)
        at = at[words.counts[doc[at]] >= n]
        h = values[at] + U64(salt)
        for k in range(1, n):
            h = mix(h) + values[at + k]
        docs.append(doc[at])
        slots.append(_slots(mix(h)))
    return np.concatenate(docs), np.concatenate(slots)


@dataclasses.dataclass
class Model:
    weight: np.ndarray  # by slot: SVM weight times ratio
    square: np.ndarray  # by slot: ratio squared, 0 if unknown
    bias: float
    calibration: tuple[float, float]

    def margins(self, words: Words) -> np.ndarray:
        n = len(words.counts)
        doc, slot = indicators(words)
        known = self.square[slot] > 0
        key = np.unique(doc[known] * TABLE + slot[known])
        doc, slot = key // TABLE, key % TABLE
        length = np.sqrt(np.bincount(doc, self.square[slot], n))
        return np.bincount(doc, self.weight[slot], n) / np.maximum(length, 1e-9) + self.bias

    def scores(self, words: Words) -> np.ndarray:
        return _labelled.probability(self.margins(words), self.calibration)


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 40, seed: int = 1) -> np.ndarray:
    """Weights of the L1-loss linear SVM; rows are (columns, values), y is -1 or 1."""
    w, alpha, draw = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    q = np.array([float(v @ v) for _, v in rows])
    for _ in range(epochs):
        most = 0.0
        for i in draw.permutation(len(rows)).tolist():
            if q[i] <= 0:
                continue
            c, v = rows[i]
            g = y[i] * float(w[c] @ v) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            if new != alpha[i]:
                w[c] += (new - alpha[i]) * y[i] * v
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-4:
            break
    return w


def train(rows: list[tuple[str, int]], cost: float = 1.0, smooth: float = 1.0) -> Model | None:
    y = np.array([r[1] for r in rows], np.int64)
    if len(rows) < 8 or y.min() == y.max():
        return None
    parts = []
    for text, _ in rows:
        _, slot = indicators(Words(pa.array([text], pa.string())))
        parts.append(np.unique(slot))
    fit = np.arange(len(rows)) % 4 != 3
    if len({*y[fit]}) < 2 or len({*y[~fit]}) < 2:
        fit[:] = True
    count = np.zeros((2, TABLE))
    for i in np.flatnonzero(fit):
        count[y[i], parts[i]] += 1
    known = count.sum(0) >= 3
    p, q = (smooth + count[1]) / (smooth + count[1]).sum(), (smooth + count[0]) / (smooth + count[0]).sum()
    ratio = np.where(known, np.log(p / q), 0.0)
    ratio[known & (np.abs(ratio) < 1e-6)] = 1e-6
    column = np.full(TABLE, -1)
    live = np.flatnonzero(known)
    column[live] = np.arange(len(live))
    vectors = []
    for slots in parts:
        s = slots[known[slots]]
        v = ratio[s]
        length = float(np.sqrt(v @ v))
        # a last column of ones is the bias
        vectors.append((np.append(column[s], len(live)), np.append(v / max(length, 1e-9), 1.0)))
    sign = np.where(y > 0, 1.0, -1.0)
    n1, n0 = max(1, int((y[fit] > 0).sum())), max(1, int((y[fit] == 0).sum()))
    each = np.where(y > 0, cost * (n1 + n0) / (2 * n1), cost * (n1 + n0) / (2 * n0))
    use = np.flatnonzero(fit)
    w = dual_descent([vectors[i] for i in use], sign[use], len(live) + 1, each[use])
    margin = np.array([float(w[c] @ v) for c, v in vectors])
    rest = ~fit if (~fit).any() else fit
    weight, square = np.zeros(TABLE, np.float32), np.zeros(TABLE, np.float32)
    weight[live] = w[:-1] * ratio[live]
    square[live] = ratio[live] ** 2
    return Model(weight, square, float(w[-1]), _labelled.platt(margin[rest], y[rest].astype(np.float64)))


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Model | None:
    return train(_labelled.sample(docs, labels, per_class=bounds.pop("per_class", PER_CLASS), row_bytes=bounds.pop("row_bytes", ROW_BYTES), **bounds))


def score(docs: DataFrame, model: Model | None, *, text: str = "text", threshold: float = THRESHOLD, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the columns ``drop``, with ``score`` (0 to 1) and ``predicted`` (1 if it is at least ``threshold``)."""
    docs = docs.drop("score", "predicted")
    kept = [c for c in docs.columns if c not in drop]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, texts in groups(batch, text, 2 << 20):
                p = m.scores(Words(texts)) if m else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.mapInArrow(run, schema)
