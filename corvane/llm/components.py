"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut


def _by_least(neighbours: DataFrame) -> DataFrame:
    """Rows (u, v) with m, the least of u and its neighbours.

    The least ones are written before the join, so that both of its sides are
    plain exchanges and the parts of a very linked id can be split.
    """
    least = cut(neighbours.groupBy("u").agg(F.min("v").alias("m")), "least").withColumnRenamed("u", "_u")
    return neighbours.join(least, F.col("u") == F.col("_u")).select("u", "v", F.least("m", "u").alias("m"))


def _stars(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """One large and one small star over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _by_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = cut(large, "large")
    joined = _by_least(large)
    down = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _marked(down.unionByName(joined.select("u", F.col("m").alias("v"))).distinct(), "small")


def _marked(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """Edges, written, and what tells them from others: their number and the sum of their hashes, taken on the way.

    A task that runs twice may spoil a mark; then it differs, and one more round is made.
    """
    seen = Observation()
    edges = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")), name)
    return edges, (seen.get["n"], seen.get["h"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (id, component) of all linked ids but the least of each component, which names it.

    Links are undirected and may repeat; links of an id to itself or to null
    say nothing. The number of rounds grows with the logarithm of the longest
    path.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    edges, before = _marked(edges.distinct(), "links")
    while before[0]:
        edges, after = _stars(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
