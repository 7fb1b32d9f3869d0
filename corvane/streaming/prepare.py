"""The row-wise part of the preparation over a stream of documents.

Text, filters and direct or mapped labels keep no state and run on a stream as
they are. Deduplication keeps text hashes within a watermark. Splits and
balancing need counts of the whole and stay batch steps over what was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalise, text_hash
from ..operators import filters, labels


def prepare_stream(docs: DataFrame, mode: str = "none", least_chars: int = 0, most_tokens: int | None = None, modality: str | None = None, mapping: DataFrame | None = None, policy: str = "drop") -> DataFrame:
    """Documents of a stream filtered, normalised and labelled; the mapping is a static table."""
    rows = filters.by_modality(docs, modality).withColumn("text", normalise("text", mode))
    rows = filters.max_tokens(filters.min_chars(rows, least_chars), most_tokens)
    return filters.with_label(labels.direct_label(rows)) if mapping is None else labels.map_label(rows, mapping, policy)


def dedup_stream(docs: DataFrame, time: str = "ts", delay: str = "1 hour", text: str = "text") -> DataFrame:
    """One document of each text within the delay; which one is the first to arrive."""
    rows = docs.withWatermark(time, delay).withColumn("_hash", text_hash(text))
    return rows.dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def label_counts(docs: DataFrame, time: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Documents of each label in windows of time, final once the watermark has passed."""
    counted = docs.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "label", "n")


def write_stream(docs: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet, exactly once by the checkpoint."""
    writer = docs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
