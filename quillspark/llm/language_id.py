"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes is fitted to a
bounded sample of labelled texts and then frozen.  A byte's code length in a
language is exact: the longest context known is tried first, an escape (method
C, with exclusion of the symbols already tried) leads to the next shorter one,
and the last resort is a uniform code over the alphabet.  A text goes to the
language that codes it in the fewest bits.

Every language of the labelled rows is learned, however rare: at most about 400 rows
of up to 100,000 bytes each (its shortest row where all are longer), and fewer, but no
less than about 20, where more than ten languages share 4,000 rows.

Because the statistics are frozen and the symbols seen after a context were all seen
after its shorter forms, what an escape excludes is known for each context: two
numbers a context (the cost of being coded one level down, and of escaping that too)
and one number a seen symbol make the whole code.  So a language is a few sorted
arrays of what it has seen, and languages add to the model what they hold themselves.
A batch is scored once for each distinct run of four symbols in it.

Defined results: null texts and texts without a letter give ``und`` with score 0;
an empty training set gives ``und`` for every row.  Extra input columns are kept
as they are except for names that the result uses.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drawn, share
from ._words import groups, merged

#: Labelled rows per language, and the longest row taken, that the model may be fitted on.
TRAIN_ROWS = 400
TRAIN_ROW_BYTES = 100_000
#: Rows in all, shared by the languages, of which each has at least ``TRAIN_LEAST``.
TRAIN_ALL, TRAIN_LEAST = 4000, 20
#: Languages in one part of a model; a worker holds one part at a time.
LANGUAGES = 200
#: Bytes of text that are scored with one of several parts before the next is loaded.
_ROUND = 32 << 20
UNDETERMINED = "und"
#: Words at which the evidence counts in full; it keeps the score of one-word texts below 1.
_FULL = 200

_LETTERS = bytes(i if chr(i).isalpha() or i >= 128 else 32 for i in range(256))


def _normal(text: str) -> bytes:
    """Lower case; ASCII characters other than letters count as a space."""
    return text.lower().encode("utf-8", "replace").translate(_LETTERS)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted ``keys``, and which of ``wanted`` are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _tables(parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs, for each row of totals and kinds [context, 2], of being coded there and of escaping from there.

    ``parent`` are those of the shorter context, ``child`` what the longer one excludes from them; where nothing
    is left the level is passed over at no cost.
    """
    left, kinds = parent[:, 0] - child[:, 0], parent[:, 1] - child[:, 1]
    coded = np.log(np.maximum(left + kinds, 1))
    return coded.astype(np.float32), np.where(left > 0, coded - np.log(np.maximum(kinds, 1)), 0.0).astype(np.float32)


class Tree:
    """The frozen statistics of one language, over an alphabet of ``a`` symbols."""

    def __init__(self, ids: np.ndarray, a: int):
        self.a = a
        ids = ids.astype(np.int64)
        four, n4 = np.unique(((ids[:-3] * a + ids[1:-2]) * a + ids[2:-1]) * a + ids[3:], return_counts=True)
        n3, n2 = (np.bincount(four % m, n4, m).astype(np.int64) for m in (a**3, a * a))  # of (context, symbol), by the context's size + 1
        three = np.flatnonzero(n3)
        two = n2.reshape(a, a)
        one = two.sum(axis=0)

        # totals and kinds of each context, and what a longer context takes away from those of the next shorter one
        c3, first = np.unique(four // a, return_index=True)
        own3 = np.stack([np.add.reduceat(n4, first), np.diff(np.append(first, len(four)))], 1) if len(four) else np.zeros((0, 2), np.int64)
        own2 = np.stack([n3.reshape(-1, a).sum(axis=1), (n3.reshape(-1, a) > 0).sum(axis=1)], 1)
        own1 = np.stack([two.sum(axis=1), (two > 0).sum(axis=1)], 1)
        own0 = np.array([[one.sum(), (one > 0).sum()]])
        gone3 = np.stack([np.add.reduceat(n3[four % a**3], first), own3[:, 1]], 1) if len(four) else own3  # counts one level down
        gone2 = np.stack([np.bincount(three // a, two.reshape(-1)[three % (a * a)], a * a), own2[:, 1]], 1)
        gone1 = np.stack([((two > 0) * one).sum(axis=1), own1[:, 1]], 1)

        self.four, self.three, self.contexts = four, three, c3
        total, kinds = (own3[:, i].astype(np.float64) for i in (0, 1))
        escape = (np.log(total + kinds) - np.log(kinds)).astype(np.float32)
        self.cost4 = (np.repeat(np.log(total + kinds), own3[:, 1]) - np.log(n4)).astype(np.float32)
        self.log3 = np.log(n3[three]).astype(np.float32)
        with np.errstate(divide="ignore"):
            self.log2, self.log1 = np.log(n2).astype(np.float32), np.log(one).astype(np.float32)
        # after a context of three that is known: coded at two, escaped from two
        coded, escaped = _tables(own2[c3 % (a * a)], gone3)
        self.coded2, self.escaped2 = escape + coded, escape + escaped
        # the same where it is unknown
        self.plain2, self.pass2 = _tables(own2, np.zeros_like(own2))
        self.coded1, self.escaped1 = _tables(own1[np.arange(a * a) % a], gone2)
        self.coded0, self.escaped0 = _tables(np.repeat(own0, a, 0), gone1)
        self.rest = np.float32(np.log(a - own0[0, 1]))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Code length in nats of the last symbol of each run of four, after the three before it."""
        a = self.a
        context, three = grams // a, grams % a**3
        two, one, symbol = context % (a * a), context % a, grams % a
        at, known = _at(self.contexts, context)
        coded = np.where(known, self.coded2[at] if len(self.contexts) else 0, self.plain2[two])
        left = np.where(known, self.escaped2[at] if len(self.contexts) else 0, self.pass2[two])
        # from the last resort up; a longer context that knows the symbol has the say
        out = left + self.escaped1[two] + self.escaped0[one] + self.rest
        n = self.log1[symbol]
        out = np.where(n >= 0, left + self.escaped1[two] + self.coded0[one] - n, out)
        n = self.log2[one * a + symbol]
        out = np.where(n >= 0, left + self.coded1[two] - n, out)
        at, known = _at(self.three, three)
        out[known] = coded[known] - self.log3[at[known]]
        at, known = _at(self.four, grams)
        out[known] = self.cost4[at[known]]
        return out


@dataclasses.dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol
    trees: list[Tree]

    def totals(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths [text, language] in nats, and symbols in each text."""
        size = np.array([len(t) for t in texts], np.int64)
        pad = b"   "
        ids = self.symbol[np.frombuffer(pad + pad.join(texts), np.uint8)].astype(np.int64)
        a = int(self.symbol.max()) + 1
        coded = pa.array(((ids[:-3] * a + ids[1:-2]) * a + ids[2:-1]) * a + ids[3:]).dictionary_encode()
        grams, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        # each text is followed by three spaces, which belong to the next one's context; they're cut off below
        begin = np.concatenate([[0], np.cumsum(size + 3)[:-1]])
        out = np.empty((len(texts), len(self.languages)))
        for k, tree in enumerate(self.trees):
            sums = np.concatenate([[0.0], np.cumsum(tree.costs(grams)[at], dtype=np.float64)])
            out[:, k] = sums[begin + size] - sums[begin]
        return out, size

    def lead(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text the best language, its nats a symbol, and the weight of all languages relative to it."""
        nats, size = self.totals(texts)
        mean = nats / np.maximum(size, 1)[:, None]
        least = mean.min(axis=1)
        weight = np.exp(-(mean - least[:, None]) * np.minimum(size, _FULL)[:, None]).sum(axis=1)
        return [self.languages[b] for b in nats.argmin(axis=1)], least, weight

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return predict_by_parts([self], texts)


def predict_by_parts(parts: Iterable[Model], texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score by all parts' languages together, holding one part at a time."""
    named, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    live = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    lines = [_normal(texts[i]) for i in live]
    full = np.minimum([len(t) for t in lines], _FULL)
    best, least, weight = [UNDETERMINED] * len(live), np.full(len(live), np.inf), np.zeros(len(live))
    for part in parts if live else ():
        if not part.languages:
            continue
        for at, to in _spans(lines):
            name, low, more = part.lead(lines[at:to])
            old, f = least[at:to], full[at:to]
            new = np.minimum(old, low)
            weight[at:to] = weight[at:to] * np.exp(-np.where(np.isinf(old), 0, old - new) * f) + more * np.exp(-(low - new) * f)
            for j in np.flatnonzero(low < old).tolist():
                best[at + j] = name[j]
            least[at:to] = new
    for j, i in enumerate(live):
        named[i], score[i] = best[j], 1 / weight[j] if weight[j] else 0.0
    return named, score


def _spans(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about 2 MB."""
    at = size = 0
    for to, line in enumerate(lines, 1):
        size += len(line)
        if size >= 2 << 20:
            yield at, to
            at, size = to, 0
    if at < len(lines):
        yield at, len(lines)


def train(rows: Iterable[tuple[str, str]]) -> Model:
    """Fit the frozen statistics of all languages to (language, text) pairs."""
    texts = _by_language(rows)
    return _fit(texts, _bytes_of(texts))


def parts(rows: Iterable[tuple[str, str]], most: int | None = None) -> Iterator[Model]:
    """The same statistics in parts of at most ``most`` languages each, over one alphabet."""
    texts = _by_language(rows)
    seen, names, most = _bytes_of(texts), sorted(texts), most or LANGUAGES
    for at in range(0, max(1, len(names)), most):
        yield _fit({k: texts[k] for k in names[at : at + most]}, seen)


def _by_language(rows: Iterable[tuple[str, str]]) -> dict[str, list[bytes]]:
    texts: dict[str, list[bytes]] = {}
    for language, text in rows:
        texts.setdefault(language, []).append(_normal(text or ""))
    return texts


def _bytes_of(texts: dict[str, list[bytes]]) -> np.ndarray:
    """Which bytes stand in any text, letters and the space included."""
    seen = np.zeros(256, bool)
    for lines in texts.values():
        seen |= np.bincount(np.frombuffer(b"".join(lines), np.uint8), minlength=256) > 0
    seen[32] = seen[97:123] = True
    return seen


def _fit(texts: dict[str, list[bytes]], seen: np.ndarray) -> Model:
    symbol = np.full(256, 1, np.uint8)  # 1: a byte never seen in training
    symbol[32] = 0
    others = np.flatnonzero(seen & (np.arange(256) != 32))
    symbol[others] = np.arange(2, 2 + len(others))
    trees = [Tree(symbol[np.frombuffer(b"   " + b"   ".join(texts[k]) + b"   ", np.uint8)], 2 + len(others)) for k in sorted(texts)]
    return Model(sorted(texts), symbol, trees)


def training_rows(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", held_out=None, rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """At most about ``rows`` labelled texts of every language (``TRAIN_ALL`` in all, or ``TRAIN_LEAST`` each), chosen by a hash.

    Languages are counted first (no text is read), which turns the bound into a
    threshold on the hash of key and text: no sort and no shuffle of texts.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if held_out is not None:
        known = known.where(~held_out)
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not counts:
        return []
    rows = max(1, min(rows, max(TRAIN_LEAST, TRAIN_ALL // len(counts))))
    if len(counts) <= LANGUAGES:
        largest = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(share(rows, n)).cast("long"))])
        shared, largest = known, largest[F.col(lang)]
    else:
        shares = docs.sparkSession.createDataFrame([(k, share(rows, n)) for k, n in counts.items()], "_lang string, _largest long")
        shared, largest = known.join(F.broadcast(shares), F.col(lang) == F.col("_lang")), F.col("_largest")
    picked = shared.where(F.octet_length(text) <= TRAIN_ROW_BYTES).where(drawn(largest, key, text, seed=17)).select(lang, text, key)
    # equal rows have one hash, so the threshold alone would not bound them
    picked = picked.orderBy(F.xxhash64(key, text)).limit(2 * rows * len(counts))
    got = [(r[0], r[1], r[2]) for r in picked.collect()]
    missing = sorted(counts.keys() - {k for k, _, _ in got})
    if missing:  # no row, or long ones only: the shortest, whole
        few = known.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in missing], "_lang string")), F.col(lang) == F.col("_lang"))
        least = few.groupBy(lang).agg(F.min_by(F.struct(text, key), F.struct(F.octet_length(text), F.xxhash64(key, text))).alias("r"))
        got += [(r[0], r["r"][0], r["r"][1]) for r in least.collect()]
    return [(k, t) for k, t, _ in sorted(got, key=lambda r: (r[0], str(r[2]), r[1]))]


def identify(docs: DataFrame, model: Model | Iterable[Model], *, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the columns ``drop``, with ``lang_pred`` and ``score`` (0 to 1), by a model or its ``parts``."""
    shared = [docs.sparkSession.sparkContext.broadcast(m) for m in ([model] if isinstance(model, Model) else model)]
    docs = docs.drop("lang_pred", "score")
    kept = [c for c in docs.columns if c not in drop]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add("lang_pred", "string").add("score", "double")

    def loaded() -> Iterator[Model]:
        for s in shared:
            yield s.value
            s.__dict__.pop("_value", None)  # read again from the worker's file in the next round

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = len(shared) == 1
        for batch in batches if one else merged(batches, _ROUND):
            for part, texts in groups(batch, text, 2 << 20 if one else _ROUND):
                named, score = predict_by_parts([shared[0].value] if one else loaded(), texts.to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], pa.array(named, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
