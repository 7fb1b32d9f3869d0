"""Set operations over corpora and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_union(corpora: dict[str, DataFrame], namespace: bool = True, ident: str = "id") -> DataFrame:
    """All corpora with ``corpus_id``; with several, ids get the corpus as prefix unless they have it."""
    parts = []
    for name, df in corpora.items():
        df = df.withColumn("corpus_id", F.lit(name))
        if namespace and len(corpora) > 1:
            own = F.col(ident).cast("string")
            df = df.withColumn(ident, F.when(own.startswith(f"{name}__"), own).otherwise(F.concat(F.lit(f"{name}__"), own)))
        parts.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def label_union(*frames: DataFrame, label: str = "label") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.select(label) for f in frames]).distinct().orderBy(label)


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def same_set(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: whether two frames have the same set of values."""
    only_a, only_b = a.select(column).subtract(b.select(column)), b.select(column).subtract(a.select(column))
    return only_a.unionByName(only_b).agg((F.count(F.lit(1)) == 0).alias("equal"))
