"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Each source's target is its weight's share of the mix, clamped at ``max_epochs``
times its size; what the clamp frees goes to the others by weight, until no target
is above its clamp.  With sources in order of clamp / weight the clamped ones are a
prefix, so the fixed point of the redistribution comes from two running sums over
the (small, aggregated) table of sources.

A source's target is then met by whole repetitions of all its documents and one
fractional repetition: documents are taken in the order of a seeded hash until the
rest is used up, the last one in part.  That order needs a running sum over a whole
source, which may hold a third of all rows; it is taken in two steps, within
(source, hash prefix) groups and over the totals of those groups, so that no task
holds a source.

Defined results: null text has size 0; sources are ordered by code point, null last;
a source of size 0 gets target 0, and its documents are kept once.  Equal rows are
interchangeable.  Every rerun gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import stored

WEIGHTS = (3, 1, 2)
SHARE, MAX_EPOCHS, SEED = 1.5, 2, 20
WORD = r"[^\x20\x09-\x0D]+"
#: Rows to a (source, hash prefix) group if one source had them all, the least hex digits of a prefix, and the most groups that are broadcast.
GROUP_ROWS, DIGITS, BROADCAST_GROUPS = 50_000, 3, 1 << 18


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row a source."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(max_epochs)).withColumn("name_pos", F.row_number().over(by_name))
    s = s.withColumn("ratio", F.col("cap") / F.col("w"))
    order = W.orderBy("ratio", "name_pos")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    whole = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy(F.lit(0)))
    s = s.withColumn("pos", F.row_number().over(order)).withColumn("level", (whole * F.lit(share) - before) / after)
    first_free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("pos", "level"))).over(W.partitionBy(F.lit(0)))
    s = s.withColumn("water", first_free["level"])
    target = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("water"))
    return s.select("source", "source_size", target.alias("target"))


def _key(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, *keep, size, source_size, target, repeats, extra, taken) for every document.

    ``repeats`` whole repetitions and ``extra`` words of one more are taken:
    taken = repeats * size + extra.
    """
    # rows of one id, or of none, are told apart by their texts
    drawn = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    digits = DIGITS
    rows = docs.count()
    while 16**digits * GROUP_ROWS < rows:
        digits += 1
    sized = docs.select("doc_id", "source", *[f"`{c}`" for c in keep], n_words(F.col("text")).alias("size"), drawn.alias("_h"))
    sized = sized.withColumn("_k", _key(F.col("source"))).withColumn("_b", F.substring("_h", 1, digits))
    # texts are read once for the sizes of groups; what comes of it is small
    totals = stored(sized.groupBy("_k", "_b").agg(F.first("source").alias("source"), F.sum("size").alias("n")), "mix-sizes")
    # _k stands for the source in the mix's own joins, as a join on null finds nothing
    sources = targets(totals.groupBy("_k").agg(F.first("source").alias("source"), F.sum("n").alias("source_size")).drop("_k"), weights, share, max_epochs)
    sources = sources.select(_key(F.col("source")).alias("_k"), "source_size", "target")
    running = F.coalesce(F.sum("n").over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = totals.select("_k", "_b", running.alias("_before")).join(sources, "_k")
    if totals.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    within = W.partitionBy("_k", "_b").orderBy("_h", "doc_id", "size")
    placed = sized.withColumn("_here", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).join(groups, ["_k", "_b"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long")
    rest = F.round(F.col("target") - F.col("repeats") * F.col("source_size")).cast("long")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - (F.col("_before") + F.col("_here"))))
    return (
        placed.withColumn("repeats", epochs)
        .withColumn("extra", extra)
        .select("doc_id", "source", *[f"`{c}`" for c in keep], "size", "source_size", "target", "repeats", "extra", (F.col("repeats") * F.col("size") + F.col("extra")).alias("taken"))
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1), F.lit(1), n.cast("int")), "")


def uncut(mixed: DataFrame) -> DataFrame:
    """A mix whose fractional repetitions end between documents: the one at the border is taken whole or not at all, whichever is nearer to the target."""
    extra = F.when(F.col("extra") * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    return mixed.withColumn("extra", extra).withColumn("taken", F.col("repeats") * F.col("size") + F.col("extra"))


def repeat(mixed: DataFrame) -> DataFrame:
    """A row for each repetition of a mix that keeps ``text``: whole copies, and the taken words of a fractional one."""
    whole = F.col("extra") == F.col("size")
    copies = F.col("repeats") + (F.col("extra") > 0).cast("long")
    rows = mixed.where(copies > 0).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return rows.withColumn("text", F.when((F.col("_i") > F.col("repeats")) & ~whole, first_words(F.col("text"), F.col("extra"))).otherwise(F.col("text"))).drop("_i")


_MIX_SQL = r"""
sized AS (
  SELECT *, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    md5('20|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h
  FROM {docs}
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), named AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS name_pos FROM sizes
), weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((name_pos - 1) % 3 + 1)::INT] AS w, (source_size * 2)::BIGINT AS cap FROM named
), ranked AS (
  SELECT *, cap / w AS ratio, row_number() OVER (ORDER BY cap / w, name_pos) AS pos,
    (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, name_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(w) OVER (ORDER BY cap / w, name_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), water AS (SELECT arg_min(level, pos) AS water FROM ranked WHERE ratio > level
), targets AS (
  SELECT source, source_size, CASE WHEN water IS NULL OR ratio <= water THEN cap::DOUBLE ELSE w * water END AS target FROM ranked, water
), placed AS (
  SELECT s.*, t.source_size, t.target, (CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 1 END)::BIGINT AS repeats,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), mixed AS (
  SELECT *, greatest(0, least(size, round(target - repeats * source_size)::BIGINT - before))::BIGINT AS extra FROM placed
)"""
ORACLE = f"WITH {_MIX_SQL.format(docs='documents')} SELECT doc_id, source, size, source_size, target, (repeats * size + extra)::BIGINT AS taken FROM mixed"
