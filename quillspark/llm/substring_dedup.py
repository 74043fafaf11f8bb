"""Exact substring dedup by fixed-block anchors.

1. The reference blocks of a document are its non-overlapping runs of ``window`` / 2
   words.  Any window that two documents share holds a whole reference block of
   each.  Every rolling run of that size probes the blocks by hash; both sides of a
   hit are kept.
2. Hits are extended to maximal repeats: each window around a hit is hashed, the
   smallest document that a hash starts in is found, and the union of the windows
   that a smaller document has is what goes.

Rolling hashes outnumber the words of a text many times in bytes if they travel as
rows, so a batch's probes travel as a few rows of packed arrays, one for each hash
bucket: five bytes of hash, byte planes of positions (which compress to little),
and a short table of documents.  Both steps aggregate within a batch before the
shuffle: what repeats there is settled there, and one copy is sent on behalf of the rest,
so a passage in a third of all documents sends one entry a batch.  A false match of
the short hash only adds a window to step 2, which compares 128 bits.

Hits and spans go back to their texts by shuffle, packed by shard of document and text.
Texts without any stay where they are: a bitmap of ``SLOTS`` bits over hashed
document ids, as at most ``SLOTS`` / 64 broadcast rows, tells the few that have to
move, at any size of the input.

Defined results: null text has no words; a null doc_id counts as larger than any;
rows with the same doc_id never remove each other's words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import scan_bytes, stored
from ._words import U64, Words, groups, mark, mix, prefix_sums, span_hashes, window_starts

WINDOW = 50
#: Compressed input to a hash bucket; there are as many buckets as the input asks for.
BUCKET_BYTES = 6 << 20
#: Bits of the map of documents that have hits or spans.
SLOTS = 1 << 26
_LAST = (1 << 63) - 1

#: Buckets from 0 on hold hashes; a bucket of -1 - n holds positions for shard n of the documents, without hashes.
_PACKED = "bucket int, hashes binary, positions binary, docs binary"
_FOUND = "rid long, tkey long, data binary"
_FOUND_ARROW = pa.schema([("rid", pa.int64()), ("tkey", pa.int64()), ("data", pa.binary())])
#: What a row of documents and a found row meet by: rows of one id, or of none, are told apart by their texts.
_TEXT = ["rid", "tkey"]


def _planes(x: np.ndarray, size: int) -> bytes:
    """The bytes of an array by significance: planes of high bytes compress to almost nothing."""
    return np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()


def _unplanes(data: bytes, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"<u{size}").reshape(-1)


def _doc_table(rid: np.ndarray, tkey: np.ndarray, doc: np.ndarray) -> bytes:
    """The documents of entries that are in order of document: id, text key and count of each."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    counts = np.diff(np.append(first, len(doc)))
    d = doc[first]
    return _planes(rid[d].view(np.uint64), 8) + _planes(tkey[d], 4) + _planes(counts, 4)


def _docs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // 16
    return _unplanes(data[: 8 * n], 8).view(np.int64), _unplanes(data[8 * n : 12 * n], 4), _unplanes(data[12 * n :], 4).astype(np.int64)


def _rows(bucket: np.ndarray, hashes: np.ndarray, pos: np.ndarray, doc: np.ndarray, rid: np.ndarray, tkey: np.ndarray) -> Iterator[tuple]:
    """A packed row for each bucket; ``hashes`` is [entry, byte]."""
    order = np.argsort(bucket, kind="stable")
    bucket, hashes, pos, doc = bucket[order], hashes[order], pos[order], doc[order]
    edge = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(bucket[a]), hashes[a:b].tobytes(), _planes(pos[a:b], 4), _doc_table(rid, tkey, doc[a:b])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _sharded(rid: np.ndarray, tkey: np.ndarray, doc: np.ndarray, pos: np.ndarray, shards: int) -> list[tuple]:
    """Packed rows of positions, one for each shard of texts; entries come in order of document."""
    shard = (mix(rid.view(np.uint64) ^ mix(tkey.astype(np.uint64))) % U64(shards)).astype(np.int64)[doc]
    return list(_rows(-1 - shard, np.zeros((len(doc), 0), np.uint8), pos, doc, rid, tkey))


def _entries(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, tkey, position) of all entries of packed rows."""
    docs = [_docs(d) for *_, d in rows]
    rid, tkey = (np.concatenate([np.repeat(d[i], d[2]) for d in docs]) for i in (0, 1))
    return rid, tkey, np.concatenate([_unplanes(p, 4) for _, _, p, _ in rows]).astype(np.int64)


def _table_rows(table: pa.Table) -> list[tuple]:
    return list(zip(*(table.column(c).to_pylist() for c in ("bucket", "hashes", "positions", "docs")), strict=True))


def _gathered(make):
    """A shard's packed positions to a row for each text of a document; ``make`` turns sorted positions into a span's data."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rid, tkey, pos = _entries(_table_rows(table))
        order = np.lexsort((pos, tkey, rid))
        rid, tkey, pos = rid[order], tkey[order], pos[order]
        edge = np.flatnonzero((np.diff(rid) != 0) | (np.diff(tkey) != 0)) + 1
        edge = np.concatenate([[0], edge, [len(rid)]]) if len(rid) else np.zeros(1, np.int64)
        data = [make(pos[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(rid[edge[:-1]]), pa.array(tkey[edge[:-1]]), pa.array(data, pa.binary())], schema=_FOUND_ARROW)

    return run


def _ids(part: pa.RecordBatch, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rid = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return rid, np.fromiter((zlib.crc32(t.as_buffer() or b"") for t in texts), np.int64, len(texts))


def _counts_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the number of equal ones, and whether it is the first of them."""
    _, first, inverse, counts = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
    leads = np.zeros(len(values), bool)
    leads[first] = True
    return counts[inverse], leads


def _probes(buckets: int, shards: int, window: int):
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in groups(batch):
                words = Words(texts)
                enough = words.counts >= window
                if not enough.any():
                    continue
                rid, tkey = _ids(part, texts)
                at = window_starts(words.offsets, block)
                doc = np.searchsorted(words.offsets, at, side="right") - 1
                live = enough[doc]
                at, doc = at[live], doc[live]
                h = span_hashes(prefix_sums(words.hashes()), at, block)
                pos = at - words.offsets[doc]
                anchor = pos % block == 0
                # what repeats within the batch and has an anchor here is settled here; one entry speaks for it elsewhere
                mine = np.unique(h[anchor])
                where = np.minimum(np.searchsorted(mine, h), len(mine) - 1)
                local = np.flatnonzero(mine[where] == h)
                counts, leads = _counts_of(h[local])
                settled = local[counts > 1]
                out = _by_text(rid[doc[settled]], tkey[doc[settled]], pos[settled], shards)
                keep = np.ones(len(h), bool)
                keep[local[(counts > 1) & ~leads]] = False
                anchor[local[counts > 1]] = True
                h, pos, doc, anchor = h[keep], pos[keep], doc[keep], anchor[keep]
                bucket = (h % U64(buckets)).astype(np.int64)
                # five bytes of hash; the lowest bit says whether it is an anchor
                short = ((h >> U64(17)) & ~U64(1)) | anchor.astype(U64)
                packed = short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                out += _rows(bucket, packed, pos, doc, rid, tkey)
                yield _batch(out, _PACKED)

    return run


def _passed_on(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, _PACKED)])


def _hits(shards: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The probes of one bucket that share an anchor's hash with another entry."""
        rows = _table_rows(table)
        if key[0].as_py() < 0:
            return _passed_on(rows)
        short = np.concatenate([np.frombuffer(h, np.uint8).reshape(-1, 5) for _, h, _, _ in rows])
        h = np.zeros((len(short), 8), np.uint8)
        h[:, :5] = short
        h = h.view("<u8").reshape(-1)
        anchor = (h & U64(1)).astype(bool)
        h = h >> U64(1)
        known = np.unique(h[anchor])
        if not len(known):
            return _passed_on([])
        near = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
        counts, _ = _counts_of(h[near])
        hit = near[counts > 1]
        rid, tkey, pos = (x[hit] for x in _entries(rows))
        return _passed_on(_by_text(rid, tkey, pos, shards))

    return run


def _by_text(rid: np.ndarray, tkey: np.ndarray, pos: np.ndarray, shards: int) -> list[tuple]:
    """Packed rows by shard of entries in any order, each once: rows that repeat a text say nothing new."""
    if not len(rid):
        return []
    order = np.lexsort((pos, tkey, rid))
    rid, tkey, pos = rid[order], tkey[order], pos[order]
    new = np.ones(len(rid), bool)
    new[1:] = (np.diff(rid) != 0) | (np.diff(tkey) != 0)
    once = new.copy()
    once[1:] |= np.diff(pos) != 0
    rid, tkey, pos, new = rid[once], tkey[once], pos[once], new[once]
    return _sharded(np.ascontiguousarray(rid[new]), tkey[new], np.cumsum(new) - 1, pos, shards)


def _windows(buckets: int, shards: int, window: int):
    """Rows (rid, text, data) with hits to packed rows of the windows around them."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in groups(batch):
                words = Words(texts)
                rid, tkey = _ids(part, texts)
                around = []
                for i, data in enumerate(part.column(2).to_pylist()):
                    n, o = int(words.counts[i]), int(words.offsets[i])
                    if data and n >= window:
                        q = np.frombuffer(data, "<u4").astype(np.int64)
                        # windows that hold the run [q, q + block) start in [q + block - window, q]
                        start = np.maximum(q + block - window, 0)
                        delta = np.zeros(n + window + 1, np.int32)
                        np.add.at(delta, start, 1)
                        np.add.at(delta, q + 1, -1)
                        around.append(o + np.flatnonzero(np.cumsum(delta)[: n - window + 1] > 0))
                if not around:
                    continue
                at = np.concatenate(around)
                doc = np.searchsorted(words.offsets, at, side="right") - 1
                wh = words.hashes()
                h = span_hashes(prefix_sums(wh), at, window)
                h2 = span_hashes(prefix_sums(mix(wh ^ U64(0xA5A5A5A5A5A5A5A5))), at, window)
                pos = at - words.offsets[doc]
                # a larger document of this batch loses what a smaller one of it has; only the smallest is sent on
                order = np.lexsort((rid[doc], h2, h))
                new = np.diff(h[order], prepend=h[order][0] ^ U64(1)) != 0
                new |= np.diff(h2[order], prepend=h2[order][0]) != 0
                least = rid[doc[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
                gone = np.zeros(len(at), bool)
                gone[order] = rid[doc[order]] > least
                out = []
                lost = np.flatnonzero(gone)
                if len(lost):
                    out += _by_text(rid[doc[lost]], tkey[doc[lost]], pos[lost], shards)
                kept = ~gone
                packed = np.stack([h[kept], h2[kept]], axis=1).astype("<u8").view(np.uint8)
                if kept.any():
                    out += list(_rows(((h[kept] >> U64(20)) % U64(buckets)).astype(np.int64), packed, pos[kept], doc[kept], rid, tkey))
                yield _batch(out, _PACKED)

    return run


def _cover(positions: np.ndarray, window: int) -> bytes:
    """Runs [from, to) of words that windows at these positions cover."""
    p = np.unique(positions.astype(np.int64))
    cut = np.flatnonzero(np.diff(p) > window)
    return np.stack([p[np.concatenate([[0], cut + 1])], p[np.concatenate([cut, [len(p) - 1]])] + window]).T.astype("<u4").tobytes()


def _removals(shards: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The windows of one bucket that start in a smaller document too."""
        rows = _table_rows(table)
        if key[0].as_py() < 0:
            return _passed_on(rows)
        h, h2 = np.concatenate([np.frombuffer(h, "<u8").reshape(-1, 2) for _, h, _, _ in rows]).T.copy()
        rid, tkey, pos = _entries(rows)
        order = np.lexsort((rid, h2, h))
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(h2[order]) != 0)
        least = rid[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = order[rid[order] > least]
        return _passed_on(_by_text(rid[gone], tkey[gone], pos[gone], shards))

    return run


def _slot() -> Column:
    return F.pmod(F.xxhash64(*_TEXT), F.lit(SLOTS))


def _marked(rows: DataFrame, found: DataFrame, has: bool) -> DataFrame:
    """Rows whose text may be in ``found`` (all that are, and a few more), or the others."""
    words = found.select(_slot().alias("s")).groupBy(F.shiftright("s", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("_bits"))
    joined = rows.withColumn("_s", _slot()).withColumn("_word", F.shiftright("_s", 6)).join(F.broadcast(words), "_word", "left")
    on = F.expr("coalesce(shiftright(_bits, cast(_s & 63 as int)) & 1, 0) = 1")
    return joined.where(on if has else ~on).select(*rows.columns)


def repeats(docs: DataFrame, *, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(rid, tkey, data): for each text that loses words, runs [from, to) of word positions as pairs of unsigned ints.

    ``rid`` is the doc_id, or the largest long for a null one, and ``tkey`` the CRC-32 of the text.
    """
    if window < 2 or window % 2:
        raise ValueError("the window has to be an even number of words")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.withColumn("tkey", F.crc32(F.col("text").cast("binary")))
    buckets = int(max(8, scan_bytes(docs) // BUCKET_BYTES))
    shards = max(4, buckets // 4)
    hits = rows.mapInArrow(_probes(buckets, shards, window), _PACKED).groupBy("bucket").applyInArrow(_hits(shards), _PACKED)
    hits = stored(hits.groupBy("bucket").applyInArrow(_gathered(lambda p: p.astype("<u4").tobytes()), _FOUND), "anchor-hits")
    around = _marked(keyed, hits, True).join(hits, _TEXT).select("rid", "text", "data")
    removed = around.mapInArrow(_windows(shards, shards, window), _PACKED).groupBy("bucket").applyInArrow(_removals(shards), _PACKED)
    return stored(removed.groupBy("bucket").applyInArrow(_gathered(lambda p: _cover(p, window)), _FOUND), "repeat-spans")


def kept_words(text: bytes, spans: list[bytes]) -> tuple[list[bytes], int]:
    """The words of a text outside the spans, and how many it has in all."""
    words = text.split()
    n = len(words)
    if not spans or not n:
        return words, n
    gone = np.zeros(n + 1, np.int32)
    for data in spans:
        pairs = np.frombuffer(data, "<u4").reshape(-1, 2).astype(np.int64)
        np.add.at(gone, np.minimum(pairs[:, 0], n), 1)
        np.add.at(gone, np.minimum(pairs[:, 1], n), -1)
    keep = np.cumsum(gone[:n]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()], n


def dedup(docs: DataFrame, *, window: int = WINDOW, text: str = "text", key: str = "doc_id", digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that stay, joined by one space, or ``kept_sha256`` of them."""
    spans = repeats(docs, window=window, text=text, key=key)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tkey", F.crc32(F.col("text").cast("binary")))
    last = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in groups(batch):
                out: list[tuple] = []
                for t, found in zip(texts, part.column(2).to_pylist(), strict=True):
                    words, n = kept_words(t.as_buffer().to_pybytes(), [found] if found else [])
                    line = b" ".join(words)
                    out.append((n, n - len(words), hashlib.sha256(line).hexdigest() if digest else line.decode("utf-8", "replace")))
                n_words, n_removed, value = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(value, pa.string())], names=["doc_id", "n_words", "n_removed", last])

    schema = f"doc_id long, n_words long, n_removed long, {last} string"
    cut = _marked(rows, spans, True).join(spans, _TEXT, "left").select("doc_id", "text", "data")
    whole = _marked(rows, spans, False).select("doc_id", "text", F.lit(None).cast("binary").alias("data"))
    return cut.mapInArrow(run, schema).union(whole.mapInArrow(run, schema))
