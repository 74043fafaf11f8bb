"""The prefix trie of conversations that share openings, merged family by family.

``FAMILY`` consecutive ids are a family; its base is the smallest in absolute value that
``FAMILY`` divides.  A conversation c is rebuilt from the first h turns of its base and its
own turns after its first h, h = crc32(decimal c) % ``HEADS``.  Texts are read once and
become a digest of 128 bits and a count of words, so only numbers are shuffled: turns and
the base's opening are dealt out by base (the cogroup), ordered and rebuilt, and a node is
named by its depth and the exclusive or of a hash of (depth, turn) over its path.  Each family's
turns are combined to its own trie where they lie; what is shuffled again, by node, is one
row for each node of a family.

Nothing walks the tree.  Members of a node are counted by family, and a node belongs to
its smallest member, whose own nodes are the end of its path.  So a subtree's sum over
distinct nodes is a sum over the node's members of what each of them owns below it,
and takes a second pass by family instead of one round for each level.

The ids that end in a node are joined in their order by blocks of families; a node with
several blocks is hashed as these stream by, one block at a time.

Defined results: null turns come first; turns of one number are in order of their
digest, repeated rows included; null role and text are empty; rows without conv_id are
in no conversation; a base without rows, or with fewer than h turns, lends what it has;
the root is there if there is any conversation.  128 bits stand for equality of turns and paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import stored

FAMILY, HEADS = 20, 4
#: Families whose ends are joined to one block of text.
BLOCK = 2048
WORD = r"[^\x20\x09-\x0D]+"
_NODE = ["depth", "x", "y"]


def _turn(role: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), role, text)


def _step(depth: Column, seed: int) -> Column:
    """What the turn (t, u) at a depth adds to the name of a path."""
    return F.xxhash64(F.lit(seed), depth, F.col("t"), F.col("u"))


def turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turn, t, u, words): turns as digests, by family."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    c = F.col("conv_id").cast("long")
    rows = conversations.where(c.isNotNull())
    return rows.select((c - c % FAMILY).alias("base"), c.alias("conv_id"), F.col("turn").cast("long").alias("turn"), _turn(role, text, 1).alias("t"), _turn(role, text, 2).alias("u"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def paths(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, depth, x, y, px, py, words, before, total, ends): a row for each node on each rebuilt conversation's path.

    ``x``, ``y`` name the node and ``px``, ``py`` its parent; ``before`` counts the words above it, ``total`` the whole path's.
    """
    order = [F.asc_nulls_first("turn"), "t", "u"]
    own = turns(conversations).repartition("base").withColumn("pos", F.row_number().over(W.partitionBy("base", "conv_id").orderBy(*order)).cast("long"))
    # a base's first turns, fewer than HEADS, beside each turn of its family
    first = F.when((F.col("conv_id") == F.col("base")) & (F.col("pos") < HEADS), F.struct(F.col("pos").alias("depth"), "t", "u", "words"))
    opening = F.sort_array(F.collect_list(first).over(W.partitionBy("base")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    met = own.withColumn("opening", opening).withColumn("h", h)
    lent = F.filter("opening", lambda o: o["depth"] <= F.col("h"))
    none = F.lit(0).cast("long")
    root = F.array(F.struct(none.alias("depth"), none.alias("t"), none.alias("u"), none.alias("words")))
    mine = F.array(F.struct((F.size(lent) + F.col("pos") - F.col("h")).alias("depth"), "t", "u", "words"))
    nothing = F.slice(root, 1, 0)
    turn = F.concat(F.when(F.col("pos") == 1, F.concat(root, lent)).otherwise(nothing), F.when(F.col("pos") > F.col("h"), mine).otherwise(nothing))
    rows = met.select("base", "conv_id", F.explode(turn).alias("o")).select("base", "conv_id", "o.*")
    path = W.partitionBy("base", "conv_id").orderBy("depth")
    to_here, whole = path.rowsBetween(W.unboundedPreceding, 0), path.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    g = lambda seed: F.when(F.col("depth") > 0, _step(F.col("depth"), seed)).otherwise(F.lit(0).cast("long"))
    named = rows.withColumn("gx", g(1)).withColumn("gy", g(2))
    named = named.withColumn("x", F.bit_xor("gx").over(to_here)).withColumn("y", F.bit_xor("gy").over(to_here)).withColumn("before", F.sum("words").over(to_here) - F.col("words"))
    named = named.withColumn("total", F.sum("words").over(whole)).withColumn("last", F.max("depth").over(whole))
    up = lambda a, b: F.when(F.col("depth") > 0, F.col(a).bitwiseXOR(F.col(b)))
    return named.select("base", "conv_id", "depth", "x", "y", up("x", "gx").alias("px"), up("y", "gy").alias("py"), "words", "before", "total", (F.col("depth") == F.col("last")).alias("ends"))


def _ends(families: DataFrame) -> DataFrame:
    """Family nodes with ``ends`` to (depth, x, y, ends_sha256), for nodes where conversations end."""
    block = F.floor(F.col("base") / (FAMILY * BLOCK)).cast("long")
    some = families.where(F.size("ends") > 0).select(*_NODE, block.alias("block"), "base", F.array_join(F.transform("ends", lambda c: c.cast("string")), ",").alias("said"))
    joined = some.groupBy(*_NODE, "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("base", "said"))), lambda s: s["said"]), ",").alias("said"))
    blocks = joined.groupBy(*_NODE).agg(F.count("*").alias("blocks"), F.first("said").alias("said"))
    short = blocks.where("blocks = 1").select(*_NODE, F.sha2("said", 256).alias("ends_sha256"))
    long = joined.join(blocks.where("blocks > 1").select(*_NODE), _NODE, "left_semi").repartition(*_NODE).sortWithinPartitions(*_NODE, "block")
    return short.unionByName(long.mapInArrow(_streamed, "depth long, x long, y long, ends_sha256 string"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of text in order of (node, block) to a digest of each node's blocks, joined by commas."""
    now, digest = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip((*_NODE, "ends_sha256"), (*now, digest.hexdigest()), strict=True))], schema=pa.schema([*((c, pa.int64()) for c in _NODE), ("ends_sha256", pa.string())]))

    for batch in batches:
        at = {c: batch.column(batch.schema.get_field_index(c)) for c in (*_NODE, "said")}
        for r in range(batch.num_rows):
            node = tuple(at[c][r].as_py() for c in _NODE)
            if node != now:
                if now is not None:
                    yield out()
                now, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(at["said"][r].as_buffer())
    if now is not None:
        yield out()


def nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node."""
    path = stored(paths(conversations), "paths")
    dealt = path.repartition("base")
    # each family's small trie
    families = stored(
        dealt.groupBy("base", *_NODE).agg(
            F.first("px").alias("px"), F.first("py").alias("py"), F.first("words").alias("words"), F.first("before").alias("before"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"),
            F.sum(F.col("total") - F.col("before")).alias("below"), F.sort_array(F.collect_list(F.when(F.col("ends"), F.col("conv_id")))).alias("ends"),
        ),
        "family-tries",
    )
    one = lambda c: F.min(c).alias(c)  # noqa: E731  the same in every family
    merged = families.groupBy(*_NODE).agg(one("px"), one("py"), one("words"), one("before"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("below").alias("below"))
    children = families.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("x").alias("cx"), F.col("y").alias("cy"), "conv_id")
    # distinct children first, so that what meets at a parent is counts
    n_children = children.groupBy("depth", "x", "y", "cx", "cy").agg(F.lit(1).alias("one")).groupBy(*_NODE).agg(F.count("*").alias("n_children"))
    trie = stored(merged.join(n_children, _NODE, "left").fillna(0, ["n_children"]), "trie")
    # a node is its smallest member's; what a member owns is the end of its path, from ``own`` words on
    owners = trie.groupBy("conv_id").agg(F.min("before").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    c = F.col("conv_id")
    owners = owners.groupBy((c - c % FAMILY).alias("base")).agg(F.map_from_entries(F.collect_list(F.struct("conv_id", F.struct("own", "leaf")))).alias("owned"))  # FAMILY entries, twice that around zero
    mine = F.col("owned")[F.col("conv_id")]
    again = path.repartition("base").join(owners, "base").withColumn("mine", mine).where("mine is not null")
    distinct = again.groupBy("base", *_NODE).agg(F.sum(F.col("total") - F.greatest("before", "mine.own")).alias("once"), F.sum("mine.leaf").alias("n_leaves"))
    below = distinct.groupBy(*_NODE).agg(F.sum("once").alias("once"), F.sum("n_leaves").alias("n_leaves"))
    parents = trie.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    whole = trie.join(below, _NODE).join(_ends(families), _NODE, "left").join(parents, ["depth", "px", "py"], "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("below") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


ORACLE = r"""
WITH t AS (SELECT conv_id AS c, conv_id - conv_id % 20 AS base, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, base, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [1::UBIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda b, i: xor(b >> 1, CASE WHEN b % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) AS r FROM (SELECT DISTINCT c, base FROM t)),
convs AS (SELECT c, base, CAST(xor(r, 4294967295::UBIGINT) % 4 AS BIGINT) AS h FROM crc),
lent AS (SELECT v.c, v.h, (SELECT count(*) FROM t b WHERE b.c = v.base AND b.pos <= v.h) AS n FROM convs v),
r AS (SELECT v.c, b.pos AS depth, b.role, b.text FROM convs v JOIN t b ON b.c = v.base AND b.pos <= v.h
    UNION ALL SELECT l.c, l.n + t.pos - l.h, t.role, t.text FROM lent l JOIN t ON t.c = l.c AND t.pos > l.h),
k AS (SELECT c, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM r),
p AS (SELECT c, depth, words, path FROM k UNION ALL SELECT c, 0, 0, '' FROM convs),
ending AS (SELECT c, max(depth) AS last FROM p GROUP BY c),
n AS (SELECT path, any_value(p.depth) AS depth, any_value(words) AS words, min(p.c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE p.depth = last), '')) AS ends_sha256 FROM p JOIN ending e ON e.c = p.c GROUP BY path),
kids AS (SELECT left(path, length(path) - 32) AS up, count(*) AS k FROM n WHERE depth > 0 GROUP BY 1),
below AS (SELECT a.path, sum((d.n_convs - 1) * d.words) AS saved, count(*) FILTER (WHERE d.path NOT IN (SELECT up FROM kids)) AS leaves FROM n a JOIN n d ON starts_with(d.path, a.path) GROUP BY a.path)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.k, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN below b ON b.path = n.path LEFT JOIN kids k ON k.up = n.path LEFT JOIN n u ON n.depth > 0 AND u.path = left(n.path, length(n.path) - 32)
"""
