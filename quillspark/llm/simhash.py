"""SimHash fingerprints, linked by pigeonring filtering.

A pair of fingerprints of ``bits`` bits that differ in at most ``tau`` of them, cut
into ``segments`` in a ring, has a segment from which every chain of l consecutive
segments differs in at most l * tau / segments bits, for every l.  The longest chain
whose budget is zero has to be equal: that is the key, one from each segment on.  A pair
that shares a key must pass the budget of each longer chain before its full distance
counts.  The ring is cut finer as fingerprints grow in number, which makes the equal
chain longer (21 bits of 64 in three segments, 30 in thirty-one), so that keys grow with
the data and the pairs of a key do not.

Fingerprints are made distinct first, so copies cost nothing.  A key with more than
``bucket`` distinct fingerprints is cut again by the same rule: of tau + 1 runs of the
bits that it leaves free, a pair within tau bits agrees in at least one, and counts in
the first of them only.  Every step fixes more bits, and no pair is lost or found twice.

Defined results: null and wordless texts have fingerprint zero and link like any
other; a component's id is its smallest doc_id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import forget, stored
from ._words import groups
from .components import components

BITS, TAU, BUCKET, SHINGLE, SEED = 64, 2, 256, 3, 42
#: Fingerprints to a key, on the average, up to which a ring is not cut finer.
PER_KEY = 8
#: A key is cut again if that leaves less than this part of its pairs.
THINNER = 0.75


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit j is set if it is set in over half of the XXH64 values of the text's shingles, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(size)])
    n = max(1, len(words) - shingle + 1)
    end = (start[min(shingle, len(words)) :] - 1)[:n].tolist()
    h = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        to = min(n, at + (1 << 15))
        values = np.fromiter((h(line[a:b], seed) for a, b in zip(start[at:to].tolist(), end[at:to], strict=True)), "<u8", to - at)
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp); ``fp`` is the fingerprint as a signed long."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in groups(batch):
                values = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def _masks(segments: int) -> list[int]:
    edge = [BITS * i // segments for i in range(segments + 1)]
    return [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(segments)]


def _chains(segments: int, size: int) -> list[int]:
    """Bits of ``size`` consecutive segments of the ring, from each segment on."""
    masks = _masks(segments)
    return [sum(masks[(i + k) % segments] for k in range(size)) for i in range(segments)]


def _equal_chain(segments: int, tau: int) -> int:
    """The longest chain whose budget is no difference at all."""
    return segments if not tau else -(-segments // tau) - 1


def ring(n: int, tau: int = TAU) -> int:
    """Segments for n distinct fingerprints: the fewest whose equal chain has keys for all but about ``PER_KEY`` of them each.

    More segments make the equal chain longer, up to ``BITS`` / tau bits, at one key a segment.
    """
    best = tau + 1
    for chain in range(1, BITS // (2 * max(tau, 1)) + 1):
        segments = chain * tau + 1
        if segments > BITS:
            break
        best = segments
        if n <= PER_KEY << (BITS * chain // segments):
            break
    return best


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _viable(difference: Column, start: Column, tau: int, segments: int) -> Column:
    """Chains from ``start`` on stay within their budgets, from the equal one up to the whole ring."""
    ok = F.lit(True)
    for size in range(_equal_chain(segments, tau), segments + 1):
        if size < segments and (size + 1) * tau // segments == size * tau // segments:
            continue  # the next longer chain has the same budget, so it has the say
        chain = F.element_at(F.array(*[F.lit(_long(c)) for c in _chains(segments, size)]), start + 1)
        ok = ok & (F.bit_count(difference.bitwiseAND(chain)) <= size * tau // segments)
    return ok


def _cut(mask: int, parts: int) -> list[int]:
    """The bits that the mask leaves free, in ``parts`` runs."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    edge = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(1 << i for i in free[edge[k] : edge[k + 1]]) for k in range(parts)]


def links(distinct: DataFrame, *, tau: int = TAU, segments: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v), u < v: all pairs within ``tau`` bits, each once.

    A pair counts only where it is met first: at the first segment from which it is viable,
    and in the first run of each cut in which it agrees.  Each level's edges are a table of
    their own.  A large key is cut while that makes fewer pairs to compare; what cutting
    cannot thin out, fingerprints that nearly all are within reach of each other, is compared as it is.
    """
    segments = segments or ring(distinct.count(), tau)
    if not 0 < tau < segments <= BITS:
        raise ValueError("the ring needs more segments than bits that may differ")
    spark = distinct.sparkSession
    #: by node: the segment it starts from, the bits that its keys fix, and the runs in which its pairs have to differ
    nodes = [(i, m, []) for i, m in enumerate(_chains(segments, _equal_chain(segments, tau)))]
    starts = F.array(*[F.struct(F.lit(i).alias("node"), F.lit(_long(m)).alias("mask")) for i, (_, m, _) in enumerate(nodes)])
    keyed = distinct.select("fp", F.explode(starts).alias("s")).select("s.node", "fp", F.col("fp").bitwiseAND(F.col("s.mask")).alias("key"))
    key, out, written = ["node", "key"], [], []
    difference = F.col("u").bitwiseXOR(F.col("v"))
    earlier = F.exists(F.sequence(F.lit(0), F.col("start") - 1), lambda s: _viable(difference, s, tau, segments))
    apart = F.forall("runs", lambda m: difference.bitwiseAND(m) != 0)
    while True:
        sizes = keyed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        shared = stored(keyed.join(sizes, key), "segments")
        written.append(shared)
        large = shared.where(F.col("n") > bucket)
        cut: dict[int, range] = {}
        for r in large.select("node").distinct().collect():  # of the tree of cuts, not of the data
            start, mask, runs = nodes[r.node]
            if mask.bit_count() < BITS - tau:
                parts = _cut(mask, tau + 1)
                cut[r.node] = range(len(nodes), len(nodes) + tau + 1)
                nodes += [(start, mask | p, runs + parts[:k]) for k, p in enumerate(parts)]
        if cut:
            finer = spark.createDataFrame([(n, c, _long(nodes[c][1])) for n, cs in cut.items() for c in cs], "node int, child int, mask long")
            below = large.join(F.broadcast(finer), "node").withColumn("below", F.col("fp").bitwiseAND(F.col("mask")))
            pairs = lambda n: F.col(n).cast("double") * F.col(n)
            counts = below.groupBy(*key, "child", "below").agg(F.first("n").alias("n"), F.count("*").alias("m"))
            thinner = stored(counts.groupBy(*key).agg(F.first(pairs("n")).alias("before"), F.sum(pairs("m")).alias("after")).where(F.col("after") < THINNER * F.col("before")).select(*key), "thinner")
            written.append(thinner)
            many = not thinner.isEmpty()
        else:
            many = False
        few = shared.where(F.col("n") <= bucket).unionByName(large.join(thinner, key, "left_anti")) if many else shared
        a, b = few.select(*key, F.col("fp").alias("u")), few.select(*key, F.col("fp").alias("v"))
        met = a.join(b, key).where((F.col("u") < F.col("v")) & (F.bit_count(difference) <= tau))
        about = spark.createDataFrame([(i, s, [_long(x) for x in runs]) for i, (s, _, runs) in enumerate(nodes)], "node int, start int, runs array<long>")
        first = met.join(F.broadcast(about), "node").where(_viable(difference, F.col("start"), tau, segments)).where(F.when(F.col("start") > 0, ~earlier).otherwise(True) & apart)
        out.append(stored(first.select("u", "v"), "links"))
        if not many:
            break
        keyed = below.join(thinner, key, "left_semi").select(F.col("child").alias("node"), "fp", F.col("below").alias("key"))
    forget(*written)
    return reduce(DataFrame.union, out)


def classes(prints: DataFrame, **options) -> DataFrame:
    """(doc_id, fp) to (doc_id, fp, component_id)."""
    prints = stored(prints, "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct, **options)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    whole = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.max("linked").alias("any"))
    # a fingerprint of one document without links needs no look-up
    found = rooted.join(whole, "root").where(F.col("any") | (F.col("n") > 1)).select("fp", "component_id")
    return prints.join(found, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
