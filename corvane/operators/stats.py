"""Corpus statistics: counts, percentiles, duplicates, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stats_key, token_count


#: Ranks that the approximate percentiles tell apart.
ACCURACY = 10_000


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def actor_counts(df: DataFrame, actor: str = "actor") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(actor), F.lit("unknown")).alias("actor")).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return counts(df, label).orderBy(F.desc("n"), label)


def length_percentiles(df: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """n, median and 90th percentile of the token counts of each label, linearly interpolated."""
    rows = df.select(label, token_count(text).alias("_t"))
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.percentile("_t", 0.5).alias("median"), F.percentile("_t", 0.9).alias("p90"))


def duplicates_per_label(df: DataFrame, label: str = "label", text: str = "text", pos: str = "pos") -> DataFrame:
    """Rows after the first of their text, charged to their own label."""
    rows = df.select(label, F.col(pos).alias("_p"), stats_key(text).alias("_h"))
    firsts = rows.groupBy("_h").agg(F.min("_p").alias("_first")).select("_first")
    again = rows.join(firsts, F.col("_p") == F.col("_first"), "left_anti")
    return again.groupBy(label).agg(F.count(F.lit(1)).alias("duplicates"))


def length_histogram(df: DataFrame, group: str = "corpus_id", text: str = "text", bins: int = 60) -> DataFrame:
    """(group, bin, n) over equal bins between each group's shortest and longest text, the last one closed; and x_limit, the 99th percentile of all."""
    words = df.select(F.col(group).cast("string").alias("g"), token_count(text).alias("w"))
    by_group = words.groupBy("g", "w").agg(F.count(F.lit(1)).alias("n"))
    span = by_group.groupBy("g").agg(F.min("w").alias("low"), F.max("w").alias("high"))
    spans = by_group.join(span.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("w") - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1))).otherwise(F.lit(0))
    limit = words.agg(F.percentile("w", 0.99).alias("x_limit"))
    return spans.groupBy(F.col("g").alias(group), place.cast("int").alias("bin")).agg(F.sum("n").alias("n")).withColumn("x_limit", limit.scalar())


def robust_limits(df: DataFrame, *columns: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """A row (column, low, high) of percentiles for each column, linearly interpolated; null without values.

    Exact at any size: approximate percentiles on either side bracket each
    wanted place, values below the bracket are only counted, and only those
    inside, about 6 in 10,000 of all, are sorted.
    """
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select("r.*").filter("v IS NOT NULL")
    counted = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares, asked = {"low": low, "high": high}, []
    brackets = []
    for c, n in counted.items():
        around = [min(1.0, max(0.0, p + side * (2 / ACCURACY + 2 / n))) for p in shares.values() for side in (-1, 1)]
        brackets.append(F.percentile_approx(F.col(c).cast("double"), around, ACCURACY).alias(c))
    found = df.agg(*brackets).first() if brackets else {}
    for c, n in counted.items():
        for i, (name, p) in enumerate(shares.items()):
            asked.append((c, name, p * (n - 1), found[c][2 * i], found[c][2 * i + 1]))
    targets = df.sparkSession.createDataFrame(asked, "column string, name string, at double, first double, last double")
    near = values.join(F.broadcast(targets), "column").filter("v <= last")  # two targets a column
    below = near.filter("v < first").groupBy("column", "name").agg(F.count(F.lit(1)).alias("below"))
    inside = near.filter("v >= first").groupBy("column", "name", "at", "v").agg(F.count(F.lit(1)).alias("n")).join(below, ["column", "name"], "left")
    upto = F.sum("n").over(Window.partitionBy("column", "name").orderBy("v"))
    inside = inside.withColumn("upto", upto + F.coalesce("below", F.lit(0)))
    place = lambda whole: F.min(F.when(F.col("upto") > whole("at"), F.col("v")))
    ends = inside.groupBy("column", "name", "at").agg(place(F.floor).alias("a"), place(F.ceil).alias("b"))
    value = (F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b")
    ends = ends.withColumn("value", F.when(F.floor("at") == F.ceil("at"), F.col("a")).otherwise(value))
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value"))).alias(name)
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(ends.groupBy("column").agg(pick("low"), pick("high")), "column", "left")


def most_common(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    return counts(df.filter(F.col(key).isNotNull()), key).orderBy(F.desc("n"), key).limit(k)


def label_shares(df: DataFrame, label: str = "label") -> DataFrame:
    return counts(df, label).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
