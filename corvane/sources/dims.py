"""Dimensions from YAML: label maps and actors, read on the driver, joined as tables."""

from __future__ import annotations

from functools import lru_cache

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label_key
from ..operators.labels import VIEWS


def load_yaml(path: str) -> dict:
    """A YAML file; an empty one is an empty mapping."""
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def label_map(raw: dict) -> tuple[list[tuple[str, str]], dict]:
    """Pairs of a label map, wrapped in ``mapping`` or flat, without blank values, and its policy for unknown labels."""
    wrapped = isinstance(raw.get("mapping"), dict)
    pairs = raw["mapping"] if wrapped else {k: v for k, v in raw.items() if k != "unknown_labels"}
    kept = [(str(k), str(v)) for k, v in pairs.items() if v is not None and not isinstance(v, dict) and str(v).strip()]
    return kept, raw.get("unknown_labels") or {}


@lru_cache(maxsize=32)
def _cached(path: str) -> tuple[tuple[tuple[str, str], ...], tuple]:
    pairs, unknown = label_map(load_yaml(path))
    return tuple(pairs), tuple(unknown.items())


def read_label_map(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(key, label) with normalised keys, the last of equal ones, and the policy."""
    pairs, unknown = _cached(path)
    return mapping_table(spark, list(pairs)), dict(unknown)


def mapping_table(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], "i int, k string, label string")
    return rows.groupBy(label_key("k").alias("key")).agg(F.max_by("label", "i").alias("label"))


def actor_tables(spark: SparkSession, actors: dict) -> tuple[DataFrame, DataFrame]:
    """Bridge (actor_id, kind, key), the last actor of a key wins, and attributes (actor_id and the views)."""
    keys, rows = [], []
    for i, (actor, info) in enumerate(actors.items()):
        info = info or {}
        rows.append((str(actor), *[None if info.get(v) is None else str(info[v]) for v in VIEWS.values()]))
        keys += [(i, str(actor), kind, str(k)) for kind, name in (("crawl", "crawls"), ("domain", "domains")) for k in info.get(name) or []]
    raw = spark.createDataFrame(keys, "i int, actor_id string, kind string, raw string")
    bridge = raw.withColumn("key", label_key("raw")).filter("key <> ''").groupBy("kind", "key").agg(F.max_by("actor_id", "i").alias("actor_id"))
    attributes = spark.createDataFrame(rows, "actor_id string, " + ", ".join(f"{v} string" for v in VIEWS.values()))
    return bridge, attributes
