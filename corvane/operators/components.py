"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import checkpointed


def _to_least(neighbours: DataFrame) -> DataFrame:
    """Rows (u, v) with m, the least of u and all its neighbours v."""
    least = neighbours.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
    return neighbours.join(least, F.col("u") == F.col("_u")).select("u", "v", F.least("m", "u").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    """What tells sets of edges apart: their number and the sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) of all linked ids but the least of each component, which names it, from undirected links (a, b).

    A large star links the greater neighbours of every id to the least one it
    knows, a small star the lesser ones; the number of rounds grows with the
    logarithm of the longest path.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges = checkpointed(edges)
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = checkpointed(_to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        joined = _to_least(large)
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.distinct())
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
