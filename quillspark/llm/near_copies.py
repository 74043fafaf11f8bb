"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal sets are one node.  The first candidates are those whose SimHash fingerprints (see ``simhash``)
are linked, by 2 or fewer differing bits, to those of one hub.  Fingerprints of 64 bits do not tell all pairs at 0.8, so what
is still apart goes on to others: these share one of ``BANDS`` keys, each made of
``ROWS`` minima of the set under random permutations: a pair at exactly 0.8 shares none with
probability (1 - 0.8 ** 4) ** 26, about one in a million, and less above.  A candidate
counts only if its similarity, taken from both whole sets, reaches ``LEAST``.

A set also has an odd sketch: bit i says whether an odd number of its shingles fall into
bucket i.  Two sketches differ in at most as many bits as their sets do in shingles, so a
pair whose sketches differ in more than its similarity allows is none; that test is made
where candidates meet, and loses nothing.

What is compared: first every node with one hub of each of its keys, then, in keys that
are still in several components, with ``HUBS`` hubs of different components.  This settles
nearly all of a group of copies at one row a node.  At last the nodes outside a key's
main component are compared with all of the key that is not in their own, which settles
the rest: no pair of a key between two components is left out.

Defined results: a text of one to four words is one shingle; wordless and null texts
are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import simhash
from ._common import forget, scan_bytes, stored
from ._words import U64, Words, groups, mix, prefix_sums, span_hashes, window_starts
from .components import components

SHINGLE, LEAST = 5, (4, 5)  # 4 / 5
BANDS, ROWS, SEED = 26, 4, 42
#: Bits of an odd sketch, hubs of a key in each turn, and members of a key that one task compares with what is left of it.
ODD, HUBS, SLICE = 1024, (1, 8), 1024
#: Texts of a block of nodes, as stored.
_BLOCK_BYTES = 16 << 20

_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), U64)


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    words = Words(pc.ascii_lower(texts))
    if not len(words.codes):
        return [np.zeros(0, U64)] * len(texts)
    sums = prefix_sums(words.hashes(SEED))
    at = window_starts(words.offsets, SHINGLE)
    found = np.zeros(len(words.codes), U64)
    found[at] = span_hashes(sums, at, SHINGLE)
    for n in range(1, SHINGLE):
        short = words.offsets[:-1][words.counts == n]
        found[short] = span_hashes(sums, short, n)
    n = np.where(words.counts >= SHINGLE, words.counts - SHINGLE + 1, np.minimum(words.counts, 1))
    return [np.unique(found[a : a + k]) for a, k in zip(words.offsets[:-1].tolist(), n.tolist(), strict=True)]


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """[text, band] keys; of an empty set all are those of the largest value."""
    out = np.full((len(sets), BANDS), ~U64(0), U64)
    live = [i for i, s in enumerate(sets) if len(s)]
    if live:
        line = np.concatenate([sets[i] for i in live])
        start = np.concatenate([[0], np.cumsum([len(sets[i]) for i in live])[:-1]])
        for b in range(BANDS):
            key = np.full(len(live), b, U64)
            for k in range(b * ROWS, (b + 1) * ROWS):
                key = mix(key + np.minimum.reduceat((line ^ _RANDOM[0, k]) * (_RANDOM[1, k] | U64(1)), start))
            out[live, b] = key
    return out


def _odd(found: np.ndarray) -> bytes:
    """Which of ``ODD`` buckets hold an odd number of the set's hashes."""
    return np.packbits(np.bincount((found >> U64(20)) & U64(ODD - 1), minlength=ODD) & 1).tobytes()


def sketches(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, node, size, bands, odd) of docs with ``text``."""
    docs = docs.select(*keys, "text")
    schema = docs.drop("text").schema.add("node", "long").add("size", "long").add("bands", ArrayType(LongType())).add("odd", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in groups(batch):
                sets = shingles(texts)
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], U64).view(np.int64)
                odd = np.frombuffer(b"".join(map(_odd, sets)), np.int64)
                lists = lambda flat, n: pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n), pa.int32()), pa.array(flat))
                columns = [pa.array(node), pa.array([len(s) for s in sets], pa.int64()), lists(_bands(sets).view(np.int64).ravel(), BANDS), lists(odd, ODD // 64)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keys))], *columns], names=[*keys, "node", "size", "bands", "odd"])

    return docs.mapInArrow(run, schema)


def _possible(a: str, b: str) -> Column:
    """Whether two nodes of different components can be near copies, by their sizes and odd sketches."""
    of = lambda name: (F.col(f"{a}.{name}"), F.col(f"{b}.{name}"))
    (x, y), (m, n), (root_a, root_b) = of("odd"), of("size"), of("root")
    low, high = LEAST
    differ = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(1, ODD // 64)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return (root_a != root_b) & (F.least(m, n) * high >= F.greatest(m, n) * low) & (differ * (high + low) <= (m + n) * (high - low))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose texts, by (node, text), are near copies.

    Nodes are dealt to blocks, and a text is sent once to each pair of blocks that compares it, not once a pair.
    """
    blocks = max(16, scan_bytes(texts) // _BLOCK_BYTES)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    placed = pairs.select(block("u").alias("bu"), block("v").alias("bv"), "u", "v")
    wanted = placed.select("bu", "bv", F.explode(F.array("u", "v")).alias("node")).distinct()
    sent = wanted.join(texts, "node").select(F.col("bu").alias("cu"), F.col("bv").alias("cv"), "node", "text")

    def compare(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        for batch in texts.to_batches():
            for part, lines in groups(batch):
                sets.update(zip(part.column(part.schema.get_field_index("node")).to_pylist(), shingles(lines), strict=True))
        keep = []
        for u, v in zip(pairs["u"].to_pylist(), pairs["v"].to_pylist(), strict=True):
            common = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
            keep.append(common * LEAST[1] >= (len(sets[u]) + len(sets[v]) - common) * LEAST[0])
        return pairs.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return placed.groupBy("bu", "bv").cogroup(sent.groupBy("cu", "cv")).applyInArrow(compare, "u long, v long")


def fingerprinted(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, hub): of ``sketches`` with ``hash``, a row a node, those whose SimHash fingerprints are linked, each with its class's smallest node, if it can be a near copy of that."""
    prints = simhash.fingerprints(docs.select(F.xxhash64("text").alias("hash"), "text"), key="hash").groupBy(F.col("doc_id").alias("hash")).agg(F.min("fp").alias("fp"))
    printed = stored(distinct.select("node", "size", "odd", "hash").join(prints, "hash").drop("hash"), "near-prints")
    links = simhash.links(stored(printed.select("fp").distinct(), "near-fingerprints"))
    classes = components(links).select(F.col("u").alias("fp"), F.col("v").alias("class"))
    m = printed.join(classes, "fp", "left").select(F.coalesce("class", "fp").alias("class"), F.struct("node", "size", "odd", F.col("node").alias("root")).alias("m"))
    hubs = m.groupBy("class").agg(F.min_by("m", "m.node").alias("h"), F.count("*").alias("n")).where("n > 1").drop("n")
    return stored(m.join(hubs, "class").where(_possible("m", "h")).select("m.node", F.col("h.node").alias("hub")), "near-likely")


def roots(found: DataFrame, docs: DataFrame, *, hubs: tuple[int, ...] = HUBS, size: int = SLICE) -> DataFrame:
    """(node, root) of each node in a component of several; ``found`` is a stored ``sketches`` with ``hash``, the XXH64 of the text."""
    distinct = found.dropDuplicates(["node"])
    keyed = distinct.select("node", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, "key"), "near-keys")
    likely = fingerprinted(distinct, docs)
    named = shared.select("node").union(likely.select(F.explode(F.array("node", "hub")).alias("node"))).distinct().join(found.groupBy("node").agg(F.min("hash").alias("hash"), F.min("size").alias("size"), F.min("odd").alias("odd")), "node")
    named = stored(named, "near-nodes")
    texts = stored(docs.select(F.xxhash64("text").alias("hash"), "text").join(named.select("node", "hash"), "hash").dropDuplicates(["node"]).select("node", "text"), "near-texts")
    nodes, linked, members = named.select("node", "size", "odd"), _joined(likely, texts, None), None
    for turn, count in enumerate(hubs):
        before, members = members, _apart(shared, nodes, linked)
        drawn = [F.min_by("m", F.xxhash64("m.node", F.lit(f"{turn}.{i}"))) for i in range(count)]
        centres = members.groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("hubs")).select("key", F.explode("hubs").alias("h"))
        linked = _joined(members.join(centres, "key").where(_possible("m", "h")).select("m.node", F.col("h.node").alias("hub")), texts, linked)
        if before is not None:
            forget(before)
    members = _apart(shared, nodes, linked)
    by_root = members.groupBy("key", "m.root").agg(F.count("*").alias("k"))
    main = by_root.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("n"))
    # a key's members are dealt to slices, and its few nodes outside the main component are sent to each of them
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / size))
    rest = members.join(main, "key").where("m.root <> main").select("key", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"), F.col("m").alias("h"))
    dealt = members.join(main, "key").select("key", F.pmod(F.xxhash64("m.node", "key"), slices).alias("slice"), "m")
    return _joined(dealt.join(rest, ["key", "slice"]).where(_possible("m", "h")).select("m.node", F.col("h.node").alias("hub")), texts, linked)


def _apart(shared: DataFrame, nodes: DataFrame, linked: DataFrame | None) -> DataFrame:
    """(key, m: node, size, odd, root) of the keys whose nodes are in several components."""
    rooted = nodes.withColumn("root", F.col("node")) if linked is None else nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = shared.join(rooted, "node").select("key", F.struct("node", "size", "odd", "root").alias("m"))
    several = members.groupBy("key").agg(F.min("m.root").alias("least"), F.max("m.root").alias("most")).where("least < most").select("key")
    return stored(members.join(several, "key"), "near-members")


def _joined(pairs: DataFrame, texts: DataFrame, linked: DataFrame | None) -> DataFrame:
    """(node, root) with what the pairs (node, hub) link in addition."""
    pairs = stored(pairs.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct(), "near-pairs")
    edges = verified(pairs, texts)
    if linked is not None:
        edges = edges.union(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return components(edges).select(F.col("u").alias("node"), F.col("v").alias("root"))
