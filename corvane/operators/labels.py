"""Labels: mapping tables with a policy for unknown values, and actors with their views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_key, text_of

POLICIES = ("drop", "keep", "other")
VIEWS = {"binary": "side_binary", "five_way": "global_five", "left_intra": "intra_left", "right_intra": "intra_right"}


def direct_label(df: DataFrame, raw: str = "label_raw") -> DataFrame:
    return df.withColumn("label", label_key(raw))


def map_label(df: DataFrame, mapping: DataFrame, policy: str = "drop", other: str = "other", raw: str = "label_raw") -> DataFrame:
    """Look the raw label's key up in a mapping (key, label).

    Misses are dropped, keep their key, or become the other label. The mapping
    is joined without a hint: the optimizer broadcasts it while it is small.
    """
    if policy not in POLICIES:
        policy = "drop"
    mapping = mapping.select(F.col("key").alias("_key"), F.col("label").alias("_label"))
    joined = df.join(mapping, label_key(raw) == F.col("_key"), "left")
    found = F.when(F.col("_label") != "", F.col("_label"))
    if policy == "keep":
        found = F.coalesce(found, label_key(raw))
    elif policy == "other":
        found = F.coalesce(found, F.lit(other))
    joined = joined.withColumn("label", found).drop("_key", "_label")
    return joined.filter(F.coalesce(F.col("label"), F.lit("")) != "")


def resolve_actor(df: DataFrame, bridge: DataFrame, actors: DataFrame, crawl: str = "crawl", domain: str = "domain") -> DataFrame:
    """Add ``actor_id`` and the actor's attributes: by domain, else by crawl.

    bridge: (actor_id, kind, key), a key once for each kind; actors: (actor_id, side_binary,
    global_five, intra_left, intra_right). Both are dimensions.
    """
    by = {kind: bridge.filter(F.col("kind") == kind).select(F.col("key").alias(f"_{kind}"), F.col("actor_id").alias(f"_by_{kind}")) for kind in ("domain", "crawl")}
    key = {"domain": label_key(text_of(domain)), "crawl": label_key(text_of(crawl))}
    for kind in ("domain", "crawl"):
        df = df.join(by[kind], (key[kind] == F.col(f"_{kind}")) & (key[kind] != "" if kind == "domain" else F.lit(True)), "left")
    df = df.withColumn("actor_id", F.coalesce("_by_domain", "_by_crawl")).drop("_domain", "_crawl", "_by_domain", "_by_crawl")
    attributes = actors.select(F.col("actor_id").alias("_actor"), *VIEWS.values())
    return df.join(attributes, F.col("actor_id") == F.col("_actor"), "left").drop("_actor")


def ideology_label(df: DataFrame, view: str = "binary", unknown: str = "drop", unknown_label: str = "unknown_actor") -> DataFrame:
    """Add ``label``, ``label_raw`` (the actor) and ``reason`` to rows with a resolved actor; drops nothing."""
    known = F.col("actor_id").isNotNull()
    missing = "unknown_actor_kept" if unknown == "keep" else "unknown_actor_dropped"
    if view not in VIEWS:
        reason: Column = F.when(~known, missing).otherwise(f"unknown_view_{view}")
        label = F.lit(None).cast("string")
    else:
        value = F.when(F.col(VIEWS[view]) != "", F.col(VIEWS[view]))
        reason = F.when(~known, missing)
        if view in ("left_intra", "right_intra"):
            side = view.partition("_")[0]
            reason = reason.when(~F.col("side_binary").eqNullSafe(F.lit(side)), f"actor_not_{side}")
        reason = reason.when(value.isNull(), "label_missing_for_view").otherwise("ok")
        label = value
    out = df.withColumn("reason", reason)
    label = F.when(F.col("reason") == "ok", label).when(F.col("reason") == "unknown_actor_kept", F.lit(unknown_label))
    return out.withColumn("label", label).withColumn("label_raw", F.col("actor_id"))


def reason_counts(df: DataFrame) -> DataFrame:
    return df.filter("reason <> 'ok'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
