"""Ranks and running sums in hash order within a few keys, without a task that holds a key.

A window over a label with a third of all rows would sort them in one task.
Since the order is a hex digest, its first digits cut every key into buckets
that are in order themselves: a row's rank is the number of rows in earlier
buckets, from sums over at most 16^digits buckets, plus its rank in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def hash_ranks(df: DataFrame, keys: list[str], order: str, ties: list[str], rank: str = "rank", total: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Add the rank (from 1) within the keys by the hex digest in ``order``, then ``ties``.

    total: the number of rows of the key. sums: new column to the column whose
    sum over the rows before it is (in the same order).
    """
    sums = sums or {}
    cell = F.substring(order, 1, DIGITS)
    keys_cell = [*keys, "_cell"]
    rows = df.withColumn("_cell", cell)
    counts = rows.groupBy(*keys_cell).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{new}") for new, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total")]
    offsets += [F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).alias(f"_before_{new}") for new in sums]
    cells = counts.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys_cell)], *offsets)
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys_cell)]
    joined = rows.join(cells, _all(same))
    inside = Window.partitionBy(*keys_cell).orderBy(order, *ties)
    out = joined.withColumn(rank, F.col("_before") + F.row_number().over(inside))
    for new, c in sums.items():
        own = F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn(new, F.col(f"_before_{new}") + own)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_cell", "_before", "_total", *[f"_key_{i}" for i in range(len(keys_cell))], *[f"_before_{new}" for new in sums])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def first_rows(df: DataFrame, keys: list[Column], pos: str = "pos") -> DataFrame:
    """Of rows with equal keys the one at the smallest position, which must be unique.

    The smallest positions are aggregated before they are shuffled, and the
    rows themselves are joined to them by position.
    """
    firsts = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(pos).alias("_first")).select("_first")
    return df.join(firsts, F.col(pos) == F.col("_first"), "left_semi")
