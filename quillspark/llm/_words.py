"""Array-at-a-time tokenising and hashing of Arrow text batches.

A word is a maximal run of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Texts are worked on in groups of about this many bytes, so that memory stays flat; one longer text is a group alone.
GROUP_BYTES = 2 << 20


def plain(column: pa.Array) -> pa.Array:
    """Any string column as a flat ``string`` array in which null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return pa.array([""] * len(column), pa.string())
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("")


def groups(batch: pa.RecordBatch, column: str = "text", most: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of a batch with their texts, each of about ``most`` bytes."""
    texts = plain(batch.column(batch.schema.get_field_index(column)))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, n = 0, len(texts)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``least`` bytes, for work whose cost goes by distinct values of a batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 and sum(b.num_rows for b in held) else held[0]
            held, size = [], 0
    if held:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield rows[0] if rows else held[0]


class Words:
    """The words of some texts: ``codes`` into ``vocab``, and ``offsets`` by text."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        self.vocab = coded.dictionary
        codes = coded.indices.to_numpy()
        blank = pc.index(self.vocab, "").as_py() if len(self.vocab) else -1
        if blank >= 0:
            keep = codes != blank
            before = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(keep, out=before[1:])
            codes, offsets = codes[keep], before[offsets]
        self.codes, self.offsets = codes, offsets
        self.counts = np.diff(offsets)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts), dtype=np.int64), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for each word occurrence, computed once per distinct word."""
        return self.vocab_hashes(seed)[self.codes]

    def vocab_hashes(self, seed: int = 0) -> np.ndarray:
        # XXH64 of each distinct word
        h = xxhash.xxh64_intdigest
        return np.fromiter((h(w, seed) for w in self.vocab.to_pylist()), U64, len(self.vocab))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, kept and grown between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        have = _POWERS[base] = np.cumprod(have, dtype=U64)
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[j] * odd**j modulo 2**64, for ``span_hashes``."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _powers(_ODD, len(values)), dtype=U64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Position-free hash of values[start : start + size]."""
    return mix((sums[start + size] - sums[start]) * _powers(_INVERSE, len(sums))[start])


def window_starts(words_offsets: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a window of ``size`` words of one text starts."""
    total = int(words_offsets[-1])
    inside = np.ones(total + 1, bool)
    # a window may not start in the last size - 1 words of a text
    ends = words_offsets[1:]
    starts = words_offsets[:-1]
    delta = np.zeros(total + 2, np.int32)
    np.add.at(delta, np.maximum(ends - size + 1, starts), 1)
    np.add.at(delta, ends, -1)
    inside[:] = np.cumsum(delta[:-1]) == 0
    return np.flatnonzero(inside[:total])


def mark(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of ``total`` positions a span [start, start + size) covers."""
    delta = np.zeros(total + size + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + size, -1)
    return np.cumsum(delta[:total]) > 0
