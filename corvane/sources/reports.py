"""JSON and table sinks, and the scan that gathers all metrics into one summary.

What goes into JSON are aggregates of a run: a few rows by label, split or
group. They are written through Spark's file system, so that any store works.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the summary, in order.
SUMMARY = (
    "corpus_id", "view", "family", "model_id", "profile", "label_field", "pipeline_version", "n_eval_docs", "accuracy", "macro_f1",
    "balanced_accuracy_by_corpus_id", "balanced_macro_f1_by_corpus_id", "precision_macro", "recall_macro",
)
_META = ("profile", "label_field", "pipeline_version", "n_eval_docs")


def write_json(spark: SparkSession, path: str, content: Any) -> None:
    """One JSON file, through Hadoop's file system."""
    write_text(spark, path, json.dumps(content, ensure_ascii=False, indent=2, sort_keys=False))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def counts_of(df: DataFrame, *columns: str) -> dict:
    """A small grouped count as a mapping."""
    return {row[0]: row[1] for row in df.select(*columns).collect()}


def scan_json(spark: SparkSession, folder: str, name: str, columns: tuple[str, ...]) -> DataFrame:
    """All files of a name below a folder: (dir, corpus_id, view, family, model_id, and the columns as strings); broken ones are empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(folder, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    rows = raw.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), at(-5).alias("corpus_id"), at(-4).alias("view"), at(-3).alias("family"), at(-2).alias("model_id"), F.from_json("value", schema).alias("j"))
    return rows.select("dir", "corpus_id", "view", "family", "model_id", *[F.col(f"j.{c}").alias(c) for c in columns])


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each metrics.json below corpus/view/family/model, with its meta_eval.json where there is one."""
    numbers = tuple(c for c in SUMMARY if c not in ("corpus_id", "view", "family", "model_id", *_META))
    metrics = scan_json(spark, folder, "metrics.json", numbers)
    meta = scan_json(spark, folder, "meta_eval.json", _META).select(F.col("dir").alias("_dir"), *_META)
    joined = metrics.join(meta, F.col("dir") == F.col("_dir"), "left")
    return joined.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in SUMMARY])


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """A small table as one file with a header."""
    df.coalesce(1).write.mode("overwrite").options(sep=sep, header="true", emptyValue="").csv(path)


def one_hot(df: DataFrame, labels: list[str], ident: str = "id", label: str = "label") -> DataFrame:
    """The documents with ``cats``, a map of every label to 1.0 or 0.0: the format for text classifiers with categories."""
    cats = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.when(F.col(label) == x, 1.0).otherwise(0.0) for x in labels]))
    return df.withColumn("cats", cats)


def write_shards(df: DataFrame, path: str, shard_docs: int = 10_000) -> None:
    """Parquet files of at most so many documents each."""
    df.write.mode("overwrite").option("maxRecordsPerFile", shard_docs).parquet(path)
