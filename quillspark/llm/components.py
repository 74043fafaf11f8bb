"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and two joins on the edges, each written to the
shared folder, so no vertex's neighbours are gathered anywhere and no lineage grows; a
round's tables go when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each vertex's larger (or its not larger) neighbours to the smallest one around it."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of comparable vertices to (u, v): each vertex but the smallest of its component, and that smallest one."""
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    while (found := mark(now)) != seen:
        seen = found
        if not seen[0]:
            break
        large = stored(_star(now, True), "star")
        before, now = now, stored(_star(large, False), "star")
        forget(before, large)
    return now
