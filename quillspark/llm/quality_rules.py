"""Quality rules: counts against fixed limits, and a calibrated n-gram logistic regression.

Hashed word n-grams (1 and 2) and character n-grams (3 and 4, of UTF-8 bytes) each
enter as shares of the text's n-grams.  The regression is fitted on a bounded sample
of labelled rows, calibrated on the part of it that it was not fitted on, and
scored in Arrow batches.

Defined results: null text has no words and fails the base rules; without labelled rows of both
classes only the base rules decide.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _labelled
from ._words import U64, Words, groups, mark, mix, window_starts

#: Rows of each class that the model may be fitted on, and the longest row taken.
PER_CLASS, ROW_BYTES = 600, 60_000
TABLE = 1 << 20
CHAR_GRAMS = (3, 4)
MIN_WORDS, MAX_REPEATED_PERCENT, THRESHOLD = 50, 50, 0.5
_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> U64(40)).astype(np.int64) & (TABLE - 1)


class Grams:
    """Table slots of the n-grams of a group of texts, by kind: (slots, text of each)."""

    def __init__(self, texts: pa.Array, words: Words):
        wh = mix(words.hashes() ^ U64(1))
        doc = words.doc_of()
        two = window_starts(words.offsets, 2)
        two = two[words.counts[doc[two]] > 1]
        self.kinds = [(np.concatenate([_slots(wh), _slots(mix(wh[two] + U64(3) * wh[two + 1]))]), np.concatenate([doc, doc[two]]))]
        raw = [t.as_buffer().to_pybytes() for t in texts]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        owner = np.repeat(np.arange(len(raw)), size)
        slots, docs = [], []
        for n in CHAR_GRAMS:
            if len(data) < n:
                continue
            v = data[: len(data) - n + 1].copy()
            for k in range(1, n):
                v = v * np.uint32(257) + data[k : len(data) - n + 1 + k]
            v = (v ^ (v >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            v = (v ^ (v >> np.uint32(13))).astype(np.int64) & (TABLE - 1)
            whole = owner[: len(v)] == owner[n - 1 :]
            slots.append(v[whole])
            docs.append(owner[: len(v)][whole])
        # grams of one text have to stand together for the segmented sum
        self.kinds += list(zip(slots, docs, strict=True))

    def sums(self, weights: list[np.ndarray], n: int) -> np.ndarray:
        """For each text the mean weight of its word n-grams plus that of its character n-grams."""
        out = np.zeros(n)
        parts = [(self.kinds[:1], weights[0]), (self.kinds[1:], weights[1])]
        for kinds, w in parts:
            total, count = np.zeros(n), np.zeros(n)
            for slots, doc in kinds:
                total += np.bincount(doc, w[slots], n)
                count += np.bincount(doc, minlength=n)
            out += total / np.maximum(count, 1)
        return out


@dataclasses.dataclass
class Model:
    weights: list[np.ndarray]  # of word slots, of character slots
    bias: float
    calibration: tuple[float, float]

    def probability(self, grams: Grams, n: int) -> np.ndarray:
        return _labelled.probability(grams.sums(self.weights, n) + self.bias, self.calibration)


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the training texts; character slots come after word slots."""
    rows, cols, values = [], [], []
    for at, text in enumerate(texts):
        a = pa.array([text], pa.string())
        g = Grams(a, Words(a))
        for base, kinds in ((0, g.kinds[:1]), (TABLE, g.kinds[1:])):
            slots = np.concatenate([k[0] for k in kinds]) if kinds else np.zeros(0, np.int64)
            c, n = np.unique(slots, return_counts=True)
            rows.append(np.full(len(c), at, np.int32))
            cols.append((c + base).astype(np.int32))
            values.append((n / max(1, n.sum())).astype(np.float32))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def train(rows: list[tuple[str, int]], steps: int = 150, ridge: float = 1e-6) -> Model | None:
    """Full-batch accelerated gradient descent on the log loss; every fourth row is left for calibration."""
    y = np.array([r[1] for r in rows], np.float64)
    if len(rows) < 8 or y.min() == y.max():
        return None
    row, col, value = _sparse([r[0] for r in rows])
    # an n-gram of fewer than three rows says nothing of another text
    col_rows = np.bincount(col, minlength=2 * TABLE)
    live = np.flatnonzero(col_rows >= 3)
    at = np.full(2 * TABLE, -1, np.int32)
    at[live] = np.arange(len(live))
    good = at[col] >= 0
    row, col, value = row[good], at[col[good]], value[good].astype(np.float64)
    scale = 1 / np.sqrt(np.bincount(col, value**2, len(live)) / len(rows) + 1e-12)  # features differ by orders of magnitude in their shares
    scale = np.minimum(scale, 1e4)
    value = value * scale[col]
    rest = np.arange(len(rows)) % 4 == 3
    if len({*y[rest]}) < 2 or len({*y[~rest]}) < 2:
        rest[:] = False
    used = ~rest
    w, bias, v, vb = np.zeros(len(live)), 0.0, np.zeros(len(live)), 0.0
    n, m = len(rows), used.sum()
    width = float(np.bincount(row, value**2, n).max()) + 1
    rate = 4 / width
    balance = np.where(y > 0, 0.5 / max(1, y[used].sum()), 0.5 / max(1, (1 - y)[used].sum())) * m
    for k in range(steps):
        momentum = k / (k + 3)
        lw, lb = w + momentum * v, bias + momentum * vb
        z = np.bincount(row, value * lw[col], n) + lb
        e = np.where(used, balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y), 0) / m
        nw, nb = lw - rate * (np.bincount(col, value * e[row], len(live)) + ridge * lw), lb - rate * e.sum()
        v, vb, w, bias = nw - w, nb - bias, nw, nb
    z = np.bincount(row, value * w[col], n) + bias
    fit = rest if rest.any() else used
    whole = np.zeros(2 * TABLE, np.float32)
    whole[live] = w * scale
    return Model([whole[:TABLE], whole[TABLE:]], float(bias), _labelled.platt(z[fit], y[fit]))


def fit(docs: DataFrame, labels: DataFrame, **bounds) -> Model | None:
    return train(_labelled.sample(docs, labels, per_class=bounds.pop("per_class", PER_CLASS), row_bytes=bounds.pop("row_bytes", ROW_BYTES), **bounds))


def measures(texts: pa.Array, words: Words) -> dict[str, np.ndarray]:
    """The counts that the base rules use, for each text."""
    n = len(texts)
    chars, symbols, dup_lines = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts.to_pylist()):
        raw = text.encode("utf-8", "replace")
        chars[i] = len(text) - len(raw) + len(raw.translate(None, _SPACE))
        symbols[i] = len(raw) - len(raw.translate(None, _SYMBOLS))
        if b"\n" in raw:
            lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
            dup_lines[i] = len(lines) - len(set(lines))
    doc = words.doc_of()
    at = window_starts(words.offsets, 3)
    c = words.codes.astype(np.uint64)
    key = mix(mix(mix(c[at] + U64(1)) + c[at + 1]) + c[at + 2]) + mix(doc[at].astype(np.uint64) + U64(7))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    repeated = mark(at[counts[inverse] > 1], 3, len(doc))
    return {"n_words": words.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(doc[repeated], minlength=n).astype(np.int64)}


def apply(docs: DataFrame, model: Model | None, *, text: str = "text", threshold: float = THRESHOLD, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the columns ``drop``, with the counts, ``base_failed``, ``quality`` (the probability) and ``kept``."""
    new = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"
    names = [x.split()[0] for x in new.split(", ")]
    docs = docs.drop(*names)
    kept = [c for c in docs.columns if c not in drop]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema
    for x in new.split(", "):
        schema = schema.add(*x.split())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, texts in groups(batch, text, 2 << 20):
                words = Words(texts)
                found = measures(texts, words)
                n = len(texts)
                failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEATED_PERCENT * found["n_words"])
                p = m.probability(Grams(texts, words), n) if m else np.ones(n)
                values = [*(pa.array(v, pa.int64()) for v in found.values()), pa.array(failed), pa.array(p, pa.float64()), pa.array(~failed & (p >= threshold))]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], *values], names=[*kept, *names])

    return docs.mapInArrow(run, schema)
