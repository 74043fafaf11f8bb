"""Token-ID output: every document's ids, compressed apart with one shared zstandard dictionary.

Layout of a store, in any folder that Spark can write:

``dictionary/``  one row: the dictionary (trained on the serialised ids of a bounded
                 sample), its SHA-256, the id width in bytes and the end id
``packs/``       rows in ascending doc_id order over (shard, pack): a run of
                 documents, their zstandard frames end to end in ``data``, and the
                 index into it: doc_ids, offsets (one more than documents), counts,
                 ids before it in its shard, and the SHA-256 of the dictionary that
                 the frames need

A short document is read by its pack's Parquet statistics, its offset, and one frame.
Spark's own committer writes the files, so a task that is lost and run again leaves
no double.

Defined results: null text is empty and has the end id alone; rows that share a doc_id
are all written, in the order of a hash of the text; null doc_ids come first.  An empty table gives
an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import drawn, scan_bytes, share
from ._words import Words, groups, merged

END_ID = 1
#: The dictionary is trained on at most about this many documents, none longer than this many bytes.
SAMPLE_ROWS, SAMPLE_ROW_BYTES, DICTIONARY_BYTES = 600, 64_000, 64 << 10
LEVEL = 3
PACK_BYTES = 1 << 20
TASK_BYTES = 32 << 20
#: Words kept encoded in a worker.
_CACHE = 60_000
#: Bytes of texts that are encoded together.
_GROUP = 4 << 20
#: A table of (shard, ids before it) is broadcast up to this many shards; a larger one is joined by shuffle.
_SHARDS = 1 << 20


#: Pipelines (fixed values) whose pre-tokens are runs of letters, single digits and runs of other signs, with lower-cased
#: text and a mark at the end of each pre-token's last id: for these, words can be cut further by plain rules.
_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Letters, then ASCII signs other than the apostrophe, ``<`` and ``_``.
_LETTERS_SIGNS = r"^(?P<letters>\p{L}+)(?P<signs>[!-&(-/:;=-@\[-^`{-~]*)$"


def _letters(word: str) -> bool:
    """Whether a word is letters alone, and still is when composed and lowered (some letters turn into a letter and a mark)."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


class Encoder:
    """Ids of whole texts from a ``tokenizers`` file.

    A tokenizer whose pattern never spans white space gives a text the ids of its
    words end to end.  So the distinct words of a group of texts are cut into letters
    and the signs after them, looked up in a bounded table of common ones, and only
    the others are encoded, many to a call; the ids of the texts are then gathered as arrays.  Texts with a special token's
    opening, and any other tokenizer, are encoded whole.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if max(t.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4")
        self.end = np.array([end_id], self.type).tobytes()
        told = json.loads(t.to_str())
        pre = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        mark = told["model"].get("end_of_word_suffix")
        self.by_word = bool(
            mark and told["model"]["type"] == "BPE" and (told.get("normalizer") or {}).get("normalizers") == _LOWERED
            and pre[0].get("pattern") == {"Regex": _RUNS} and pre[0].get("invert") and len(pre) == 2 and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"]
        )
        if self.by_word:
            self.last = np.zeros(t.get_vocab_size(with_added_tokens=True), bool)
            for token, i in t.get_vocab(with_added_tokens=False).items():
                self.last[i] = token.endswith(mark)
            # the same model without the pattern: for words that are one pre-token each
            self.ascii, self.letters = Tokenizer(t.model), Tokenizer(t.model)
            self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.letters.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
            self.common = pa.array([], pa.string())  # words seen again and again, with their ids
            self.common_ids, self.common_size = np.zeros(0, self.type), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.type) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretokens(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one pre-token each, and how many each has: encoded as one text, cut where a pre-token ends."""
        parts = [np.array(tokenizer.encode(" ".join(words[at : at + 2000]), add_special_tokens=False).ids, self.type) for at in range(0, len(words), 2000)]
        ids = np.concatenate(parts) if parts else np.zeros(0, self.type)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not end every pre-token with its mark")
        return ids, np.diff(ends, prepend=0)

    def _words(self, letters: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of distinct words of letters, which occur so many times."""
        at = pc.index_in(letters, self.common).fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(at < 0)
        plain = pc.string_is_ascii(letters).to_numpy(zero_copy_only=False)[new]
        order = np.concatenate([new[plain], new[~plain]])
        a, na = self._pretokens(self.ascii, letters.take(pa.array(new[plain])).to_pylist())
        b, nb = self._pretokens(self.letters, letters.take(pa.array(new[~plain])).to_pylist())
        ids, size_new = np.concatenate([self.common_ids, a, b]), np.concatenate([na, nb])
        common_start = np.cumsum(self.common_size) - self.common_size
        start, size = np.empty(len(letters), np.int64), np.empty(len(letters), np.int64)
        start[order], size[order] = len(self.common_ids) + np.cumsum(size_new) - size_new, size_new
        old = np.flatnonzero(at >= 0)
        start[old], size[old] = common_start[at[old]], self.common_size[at[old]]
        again = new[times[new] > 1]
        if len(again) and len(self.common) < _CACHE:
            self.common = pa.concat_arrays([self.common, letters.take(pa.array(again))])
            self.common_ids = np.concatenate([self.common_ids, ids[_ragged(start[again], size[again])]])
            self.common_size = np.concatenate([self.common_size, size[again]])
        return ids, start, size

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Serialised ids of each text, with the end id."""
        if not self.by_word:
            return [x.tobytes() + self.end for x in self._ids(texts.to_pylist())]
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        words = Words(texts)
        cut = pc.extract_regex(words.vocab, _LETTERS_SIGNS)
        letters, signs = (pc.struct_field(cut, i) for i in (0, 1))
        # only letters without a mark after them are lowered here: marks are composed before the tokenizer lowers
        letters = pc.if_else(pc.string_is_ascii(letters), pc.ascii_lower(letters), letters).dictionary_encode()
        signs = signs.dictionary_encode()
        safe = np.array([w.isascii() or _letters(w) for w in letters.dictionary.to_pylist()], bool)
        code = letters.indices.fill_null(0).to_numpy(zero_copy_only=False)
        whole = pc.is_valid(cut).to_numpy(zero_copy_only=False) & (safe[code] if len(safe) else False)
        # each distinct word is letters and signs, or (rarely) something else that is encoded by itself
        used = np.flatnonzero(safe)
        ids, start, size = self._words(letters.dictionary.take(pa.array(used)), np.bincount(code[words.codes], minlength=len(safe))[used])
        rest = [*signs.dictionary.to_pylist(), *words.vocab.take(pa.array(np.flatnonzero(~whole))).to_pylist()]
        more = self._ids(rest)
        more_size = np.array([len(x) for x in more], np.int64)
        more_start = len(ids) + np.cumsum(more_size) - more_size
        ids = np.concatenate([ids, *more])
        piece = np.zeros((len(words.vocab), 2, 2), np.int64)  # start and size of the two parts
        place = np.full(len(safe), -1)
        place[used] = np.arange(len(used))
        w = np.flatnonzero(whole)
        piece[w, 0, 0], piece[w, 0, 1] = start[place[code[w]]], size[place[code[w]]]
        sign = signs.indices.fill_null(0).to_numpy(zero_copy_only=False)[w]
        piece[w, 1, 0], piece[w, 1, 1] = more_start[sign], more_size[sign]
        odd = np.flatnonzero(~whole)
        piece[odd, 0, 0], piece[odd, 0, 1] = more_start[len(signs.dictionary) :], more_size[len(signs.dictionary) :]
        flat = ids[_ragged(piece[:, :, 0].reshape(-1), piece[:, :, 1].reshape(-1))]
        size = piece[:, :, 1].sum(axis=1)
        start = np.cumsum(size) - size
        n = size[words.codes]
        edge = np.concatenate([[0], np.cumsum(n)])[words.offsets].tolist()
        ids = flat[_ragged(start[words.codes], n)]
        out = [ids[a:b].tobytes() + self.end for a, b in zip(edge[:-1], edge[1:], strict=True)]
        for i in np.flatnonzero(special).tolist():
            out[i] = self._ids([texts[i].as_py()])[0].tobytes() + self.end
        return out


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, end to end."""
    after = np.cumsum(size)
    return np.arange(int(after[-1]) if len(after) else 0) + np.repeat(start - (after - size), size)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One per worker process: loading the vocabulary takes longer than a small batch."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def train_dictionary(samples: list[bytes]) -> bytes:
    """Empty if there is too little to train on; frames then stand alone."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _with(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


PACK = "shard int, pack int, first_doc_id long, last_doc_id long, before long, n_tokens long, dict_sha256 string, doc_ids array<long>, offsets array<int>, counts array<long>, data binary"


def write(docs: DataFrame, to: str, *, tokenizer: str, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> None:
    """Write the store of ``docs`` under the folder ``to``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, end_id)
        for batch in merged(batches, _GROUP):
            for _, texts in groups(batch, most=_GROUP):
                yield pa.RecordBatch.from_arrays([pa.array(e.encode(texts), pa.binary())], names=["ids"])

    n = rows.count()
    picked = rows.where(F.octet_length("text") <= SAMPLE_ROW_BYTES).where(drawn(share(SAMPLE_ROWS, n), "doc_id", "text", seed=5))
    picked = picked.orderBy(F.xxhash64("doc_id", "text")).limit(2 * SAMPLE_ROWS)  # equal rows have one hash
    samples = sorted(bytes(r[0]) for r in picked.mapInArrow(serialised, "ids binary").collect())
    dictionary = train_dictionary(samples)
    digest = hashlib.sha256(dictionary).hexdigest()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
    spark.createDataFrame([(bytearray(dictionary), digest, width, end_id)], "dictionary binary, sha256 string, width int, end_id int").coalesce(1).write.parquet(f"{to}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, zip_ = encoder(tokenizer, end_id), zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=False, **_with(shared.value))
        shard, number = TaskContext.get().partitionId(), 0
        ids: list = []
        before = 0
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            real = [i for i in ids if i is not None]
            values = [shard, number, min(real, default=None), max(real, default=None), before, sum(counts), digest, ids, offsets.tolist(), counts, b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in PACK.split(", ")])

        for batch in merged(batches, _GROUP):
            for part, texts in groups(batch, most=_GROUP):
                for doc_id, raw in zip(part.column(0).to_pylist(), e.encode(texts), strict=True):
                    frame = zip_.compress(raw)
                    if frames and held + len(frame) > PACK_BYTES:
                        yield row()
                        before += sum(counts)
                        number, ids, counts, frames, held = number + 1, [], [], [], 0
                    ids.append(doc_id)
                    counts.append(len(raw) // e.type.itemsize)
                    frames.append(frame)
                    held += len(frame)
        if frames:
            yield row()

    parts = max(2 * spark.sparkContext.defaultParallelism, scan_bytes(rows) // TASK_BYTES)
    # the hash spreads the rows of one id, or of none, over as many tasks as they fill
    ordered = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(int(parts), "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    ordered.drop("_h").mapInArrow(pack, PACK).write.option("compression", "uncompressed").parquet(f"{to}/packs")


def read(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, ids): every document's ids, and how many ids stand before it."""
    return _read(spark, store, "ids array<long>", pa.list_(pa.int64()), lambda ids: ids)


def digests(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), from the files of a store."""

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<u4").tobytes())

    return _read(spark, store, "ids_crc32 long", pa.int64(), crc)


def _read(spark: SparkSession, store: str, column: str, kind: pa.DataType, make) -> DataFrame:
    packs = spark.read.schema(PACK).parquet(f"{store}/packs")
    head = spark.read.parquet(f"{store}/dictionary").first()
    dictionary, digest, width = bytes(head["dictionary"]), head["sha256"], head["width"]
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary is not the one that its hash names")
    shared = spark.sparkContext.broadcast(dictionary)
    # ``before`` counts within a shard; the shards before it add a row for each task that wrote
    shards = packs.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    base = shards.select("shard", F.coalesce(F.sum("_n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    few = shards.count() <= _SHARDS  # reads one column of the packs
    rows = packs.join(F.broadcast(base) if few else base.hint("shuffle_hash"), "shard").select("doc_ids", "offsets", "counts", "data", "dict_sha256", (F.col("_base") + F.col("before")).alias("_start"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor(**_with(shared.value))
        dtype = np.dtype(f"<u{width}")
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, offsets, counts, data, sha, start = (batch.column(k)[i].as_py() for k in range(6))
                if sha != digest:
                    raise ValueError("a pack needs another dictionary")
                n = np.array(counts, np.int64)
                out = [make(np.frombuffer(unzip.decompress(data[a:b]), dtype)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                before = start + np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(out, kind)], names=["doc_id", "start", "n_tokens", column.split()[0]])

    return rows.mapInArrow(unpack, f"doc_id long, start long, n_tokens long, {column}")
