"""Nearest vectors by inner product: multiprobe p-stable hashing with an exact reranking.

Largest inner product becomes smallest distance with one more component: a row x gets
sqrt(M^2 - |x|^2), M the longest row's length, a query gets 0.  A table hashes a vector to the
floors of m random projections, each shifted and divided by a width.  A query visits its own
bucket of each table and then neighbouring ones, in order of the estimated success of
the steps: the sum of squared distances from its projections to the slots' borders, least
first.  What the tables' buckets hold is reranked by exact inner products and merged.

Equal vectors are one class first, with its smallest ids, so copies cost nothing.  A bounded
sample of queries with their true neighbours (one scan) chooses m, width and number of
probes: of the settings that reach ``TARGET`` on the sample, the one with the least
expected work; where none does, one bucket that holds all.  A bounded sample of rows gives each
query a floor, its best sampled scores, below which no row of a bucket is passed on; these rows count
as found.  Every row is in every table.  A bucket is cut into cells of at most about ``CELL_ROWS`` rows by
``CELL_QUERIES`` queries, all of which meet, so none is capped and none fills a task.

Defined results: rows without id, and vectors that are null, empty, zero, of another
length than most, or that hold null or non-finite components take no part.  A row
repeated with the same id and vector counts once.  Ties go to the smaller id.  A query's own id is never found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import stored
from ._words import mix

K, TABLES, TARGET, SEED = 20, 2, 0.96, 13
#: Bounds of the samples: queries, rows, and bytes of the rows.
FIT_QUERIES, FLOOR_ROWS, FLOOR_BYTES = 128, 4096, 8 << 20
#: Probes of a table at most, rows that a probe costs as much as, widths tried (in distances of k-th neighbours), rows a bucket on the average.
PROBES, PROBE_COST, WIDTHS, BUCKET_ROWS = 256, 8, (1.3, 1.8, 2.5), 32
CELL_ROWS, CELL_QUERIES, CHUNK = 4096, 2048, 256


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _vectors(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()).cast(kind))


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up in an order that depends on their length alone."""
    return (q * x).sum(axis=1)


def steps(inside: np.ndarray, n: int) -> np.ndarray:
    """The n likeliest steps (-1, 0, 1 for each projection) from a query's bucket, given how far inside its slots (0 to 1) it is."""
    m = len(inside)
    cost = np.concatenate([inside, 1 - inside]) ** 2
    order = np.argsort(cost, kind="stable")
    by = cost[order].tolist()
    which, way = (order % m).tolist(), np.where(order < m, -1, 1).tolist()
    out = np.zeros((n, m), np.int64)
    heap, found = [(by[0], (0,))], 1
    while heap and found < n:
        score, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if len({which[j] for j in chosen}) == len(chosen):
            for j in chosen:
                out[found, which[j]] = way[j]
            found += 1
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - by[last] + by[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + by[last + 1], (*chosen, last + 1)))
    return out[:found]


class Hash:
    """Tables of m projections with one width, and how many buckets of each a query visits."""

    def __init__(self, d: int, longest: float, m: int, width: float, probes: int = PROBES):
        draw = np.random.default_rng(SEED)
        self.longest, self.m, self.width, self.probes = longest, m, width, probes
        self.lines, self.shift = draw.standard_normal((d + 1, TABLES * m)), draw.random(TABLES * m)
        self.odd = draw.integers(1 << 62, size=m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def place(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections in slots, (rows, TABLES, m)."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return ((x @ self.lines[:-1] + more[:, None] * self.lines[-1]) / self.width + self.shift).reshape(len(x), TABLES, self.m)

    def keys(self, slots: np.ndarray) -> np.ndarray:
        """Slots (..., m) to bucket keys."""
        with np.errstate(over="ignore"):
            return mix((slots.astype(np.int64).view(np.uint64) * self.odd).sum(axis=-1, dtype=np.uint64)).view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return self.keys(np.floor(self.place(x, False)))

    def visits(self, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, table, keys in order of estimated success)."""
        at = self.place(x, True)
        slot = np.floor(at)
        for i in range(len(x)):
            for t in range(TABLES):
                yield i, t, self.keys(slot[i, t].astype(np.int64) + steps(at[i, t] - slot[i, t], self.probes))


def fit(queries: np.ndarray, near: np.ndarray, rows: np.ndarray, n: int, longest: float) -> Hash:
    """Queries (f, d), their nearest (f, k, d; null where there are fewer), sampled rows (r, d): the cheapest setting that finds ``TARGET`` of the nearest."""
    d, there = queries.shape[1], ~np.isnan(near[:, :, 0])
    one = Hash(d, longest, 1, 1e9 * max(longest, 1e-9), 1)
    if not there.any():
        return one
    far = 2 * longest**2 if longest else 1.0
    gap = np.sqrt(np.maximum(longest**2 + (queries * queries).sum(axis=1)[:, None] - 2 * np.einsum("fd,fkd->fk", queries, np.nan_to_num(near)), 1e-12 * far))
    typical = float(np.median(gap[there]))
    most = max(1, round(np.log(max(n / BUCKET_ROWS, 3)) / np.log(3)))
    best, least = one, float("inf")
    flat = np.nan_to_num(near).reshape(-1, d)
    for m in range(max(1, most - 2), most + 1):
        for width in WIDTHS:
            h = Hash(d, longest, m, width * typical)
            at, own = h.buckets(flat).reshape(*near.shape[:2], TABLES), h.buckets(rows)
            found, met = np.full(near.shape[:2], PROBES), np.full((len(queries), len(rows)), PROBES)
            for i, t, keys in h.visits(queries):
                order = np.argsort(keys, kind="stable")
                for of, into in ((at[i, :, t], found[i]), (own[:, t], met[i])):
                    j = np.minimum(np.searchsorted(keys, of, sorter=order), len(keys) - 1)
                    np.minimum(into, np.where(keys[order[j]] == of, order[j], PROBES), out=into)
            reach = np.sort(found[there])
            probes = int(reach[min(len(reach) - 1, int(np.ceil(TARGET * len(reach))) - 1)]) + 1
            if probes > PROBES:
                continue
            cost = TABLES * probes * PROBE_COST + (met < probes).mean() * n
            if cost < least:
                h.probes, best, least = probes, h, cost
    return best


def _valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): ids and vectors that take part, whatever their length."""
    kind = dict(rows.dtypes)[vector]
    v = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def _best(score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of a row of scores, ties to the smaller id."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= edge)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((first[some], -score[some]))][:k]


def _scan(sample: np.ndarray, k: int, kind: pa.DataType):
    """Rows (c, first, v) to the sampled queries' k best of a task: (s, c, first, score, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, sample.shape[1])))] * len(sample)
        for batch in batches:
            if not batch.num_rows:
                continue
            c, first, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            scores = sample @ x.T
            for i, (s, cs, fs, xs) in enumerate(held):
                own = np.flatnonzero(scores[i] >= s.min()) if len(s) == k else np.arange(len(x))
                if len(own):
                    s, fs = np.concatenate([s, scores[i, own]]), np.concatenate([fs, first[own]])
                    keep = _best(s, fs, k)
                    held[i] = (s[keep], np.concatenate([cs, c[own]])[keep], fs[keep], np.concatenate([xs, x[own]])[keep])
        for i, (s, cs, fs, xs) in enumerate(held):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(cs), pa.array(fs), pa.array(s), _vectors(xs, kind)], names=["s", "c", "first", "score", "v"])

    return run


def _floors(ids: np.ndarray, first: np.ndarray, rows: np.ndarray, k: int):
    """Query classes (c, v) with what the sampled rows give them: (c, v, floor, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                q = _matrix(part.column(1))
                scores = q @ rows.T
                size = np.sqrt((q * q).sum(axis=1))
                near, floor = [], np.full(len(q), -np.inf)
                for i in range(len(q)):
                    keep = _best(scores[i], first, k)
                    exact = _dots(q[i][None], rows[keep])
                    near.append([{"c": int(a), "first": int(b), "score": float(s)} for a, b, s in zip(ids[keep], first[keep], exact, strict=True)])
                    if len(keep) == k:
                        floor[i] = exact.min() - 1e-9 * size[i] * max(1e-300, np.abs(rows).max())
                kind = pa.list_(pa.struct([("c", pa.int64()), ("first", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(floor), pa.array(near, kind)], names=["c", "v", "floor", "near"])

    return run


def _meet(k: int):
    """A cell's rows and queries to each query's k best there that reach its floor."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and queries.num_rows:
            c, first, x = rows["c"].to_numpy(), rows["first"].to_numpy(), _matrix(rows["v"])
            ids, floor, q = queries["c"].to_numpy(), queries["floor"].to_numpy(), _matrix(queries["v"])
            for at in range(0, len(q), CHUNK):
                scores = q[at : at + CHUNK] @ x.T
                for i in np.flatnonzero((scores >= floor[at : at + CHUNK, None]).any(axis=1)).tolist():
                    some = np.flatnonzero(scores[i] >= floor[at + i])
                    keep = some[_best(scores[i, some], first[some], k)]
                    out.append((np.full(len(keep), ids[at + i]), c[keep], first[keep], _dots(q[at + i][None], x[keep])))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        return pa.table(dict(zip(("q", "c", "first", "score"), map(pa.array, columns), strict=True)))

    return run


def nearest(rows: DataFrame, *, k: int = K, key: str = "vec_id", vector: str = "embedding", every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id that ``every`` divides, the k rows found with the largest inner product."""
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    valid = _valid(rows, key, vector)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    lengths = valid.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sqrt(F.max(norm)).alias("longest")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d, longest = lengths.d, float(lengths.longest)
    kind = pa.float32() if dict(valid.dtypes)["v"] == "array<float>" else pa.float64()
    sql = dict(valid.dtypes)["v"]
    hashed = valid.where(F.size("v") == d).select("vec_id", "v", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))
    same = ["h1", "h2"]
    named = stored(hashed.select(*same, "vec_id").distinct(), "vector-names")
    is_query = F.col("vec_id") % every == 0
    # of a class the k + 1 smallest ids can be found, whatever its size
    place = F.row_number().over(W.partitionBy(*same).orderBy("vec_id"))
    ids = named.withColumn("place", place).where(F.col("place") <= k + 1).groupBy(*same).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = named.where(is_query).groupBy(*same).agg(F.count("*").alias("asked"))
    classes = hashed.groupBy(*same).agg(F.first("v").alias("v")).join(ids, same).join(asked, same, "left").fillna(0, ["asked"])
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()).withColumn("first", F.element_at("ids", 1)), "vector-classes")
    n = classes.count()
    drawn = lambda df, most: df.orderBy(F.xxhash64("h1"), "h2").limit(most)
    asking = classes.where("asked > 0")
    sample = drawn(asking, FIT_QUERIES).select("c", "v").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    fixed = drawn(classes, max(1, min(FLOOR_ROWS, FLOOR_BYTES // (8 * d)))).select("c", "first", "v").collect()
    queries, floor_rows = (np.array([r.v for r in x], np.float64).reshape(-1, d) for x in (sample, fixed))
    scanned = classes.select("c", "first", "v").mapInArrow(_scan(queries, k + 1, kind), f"s long, c long, first long, score double, v {sql}")
    best = scanned.withColumn("place", F.row_number().over(W.partitionBy("s").orderBy(F.desc("score"), "first"))).where(F.col("place") <= k + 1)
    near = np.full((len(sample), k, d), np.nan)
    taken = [0] * len(sample)
    for r in best.orderBy("s", "place").collect():  # FIT_QUERIES x (k + 1) rows at most
        if r.c != sample[r.s].c and taken[r.s] < k:
            near[r.s, taken[r.s]] = r.v
            taken[r.s] += 1
    h = fit(queries, near, floor_rows, n, longest)

    def into_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = h.buckets(_matrix(batch.column(2)))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(keys[:, t]), *batch.columns], names=["t", "key", "c", "first", "v"])

    def into_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                found = [(i, t, np.unique(keys)) for i, t, keys in h.visits(_matrix(part.column(1)))]
                size = [len(keys) for _, _, keys in found]
                of = pa.array(np.repeat([i for i, _, _ in found], size))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([t for _, t, _ in found], np.int32), size)), pa.array(np.concatenate([keys for _, _, keys in found])), part.column(0).take(of), part.column(2).take(of)], names=["t", "key", "c", "floor"])

    asking = stored(asking.select("c", "v").mapInArrow(_floors(np.array([r.c for r in fixed]), np.array([r["first"] for r in fixed]), floor_rows, k + 1), f"c long, v {sql}, floor double, near array<struct<c: long, first: long, score: double>>"), "vector-queries")
    index = classes.select("c", "first", "v").mapInArrow(into_buckets, f"t int, key long, c long, first long, v {sql}")
    visits = stored(asking.select("c", "v", "floor").mapInArrow(into_visits, "t int, key long, c long, floor double"), "vector-visits")
    bucket = ["t", "key"]
    held = index.groupBy(*bucket).agg(F.ceil(F.count("*") / CELL_ROWS).alias("row_cells"))
    met = visits.groupBy(*bucket).agg(F.ceil(F.count("*") / CELL_QUERIES).alias("query_cells"))
    cells = stored(held.join(met, bucket), "vector-cells")
    every_cell = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own_cell = lambda c: F.pmod(F.xxhash64("c"), F.col(c))
    index = index.join(cells, bucket).withColumn("a", own_cell("row_cells")).withColumn("b", every_cell("query_cells")).select(*bucket, "a", "b", "c", "first", "v")
    visits = visits.join(cells, bucket).withColumn("b", own_cell("query_cells")).withColumn("a", every_cell("row_cells")).join(asking.select("c", "v"), "c").select(*bucket, "a", "b", "c", "floor", "v")
    cell = [*bucket, "a", "b"]
    found = index.groupBy(*cell).cogroup(visits.groupBy(*cell)).applyInArrow(_meet(k + 1), "q long, c long, first long, score double")
    sampled = asking.select(F.col("c").alias("q"), F.explode("near").alias("o")).select("q", "o.*")
    merged = found.unionByName(sampled).groupBy("q", "c").agg(F.first("first").alias("first"), F.max("score").alias("score"))
    top = merged.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "first"))).where(F.col("place") <= k + 1)
    each = top.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    each = each.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    lists = each.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    lists = lists.join(classes.select(F.col("c").alias("q"), *same), "q").select(*same, "found")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    answers = named.where(is_query).withColumnRenamed("vec_id", "query_id").join(lists, same).select("query_id", F.posexplode(others).alias("at", "f"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
