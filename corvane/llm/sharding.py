"""Sharding by minimax contiguous partition, in DataFrame and SQL functions only.

Equal texts share a bucket (a hash of the text), so buckets are atomic groups
in a fixed order and at most ``buckets`` of them exist at any input size. A
binary search over the capacity, each probe a greedy pass over the ordered
bucket sizes, finds the smallest capacity that fits; the shards are cut there.
Slots come from two prefix sums, over the cells of a bucket and over buckets,
and a cell has about the square root of its bucket's rows, dealt by their place
in the table, so that neither a hot text nor a hot bucket ever meets in one
task, whatever the ids are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, digest_long, narrow


def _fits(capacity: str, shards: int) -> str:
    """SQL: whether a greedy pass over ``sizes`` needs no more than the shards."""
    return f"""aggregate(sizes, named_struct('shard', 1, 'load', 0L),
        (a, x) -> if(a.load + x > {capacity}, named_struct('shard', a.shard + 1, 'load', x),
                     named_struct('shard', a.shard, 'load', a.load + x)), a -> a.shard <= {shards})"""


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Capacity and the first groups of the second and later shards.

    groups: ``bucket`` int and ``bytes`` long, one row per group, of a number
    that doesn't grow with the data. What reaches the driver is the cuts.
    """
    one = groups.agg(F.sort_array(F.collect_list(F.struct("bucket", "bytes"))).alias("g"))
    one = one.selectExpr("g", "transform(g, x -> x.bytes) AS sizes")
    one = one.selectExpr("*", "coalesce(array_max(sizes), 0L) AS most", f"CAST(ceil(aggregate(sizes, 0L, (a, x) -> a + x) / {shards}) AS BIGINT) AS fair")
    search = f"""aggregate(sequence(1, 64), named_struct('low', greatest(most, fair), 'high', fair + most),
        (s, i) -> if(s.low >= s.high, s,
            if({_fits("((s.low + s.high) div 2)", shards)}, named_struct('low', s.low, 'high', (s.low + s.high) div 2),
               named_struct('low', (s.low + s.high) div 2 + 1, 'high', s.high))), s -> s.low)"""
    cuts = """aggregate(g, named_struct('load', 0L, 'cuts', CAST(array() AS ARRAY<INT>)),
        (a, x) -> if(a.load + x.bytes > capacity, named_struct('load', x.bytes, 'cuts', concat(a.cuts, array(x.bucket))),
                     named_struct('load', a.load + x.bytes, 'cuts', a.cuts)), a -> a.cuts)"""
    row = one.selectExpr("g", f"{search} AS capacity").selectExpr("capacity", f"{cuts} AS cuts").first()
    return row["capacity"], list(row["cuts"])


def shard_by_bytes(docs: DataFrame, shards: int = 8, buckets: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A size is the UTF-8 bytes of the text (null: none) plus 1; null and empty
    texts are one group. The law is ``bytes``: the fullest shard is as small as
    contiguous buckets allow, and equal texts share a shard. Slots number each
    shard gaplessly from 0, in any order within a text's bucket; ids may be null
    and repeat. A text of any length counts whole, and one larger than a shard's
    fair share makes the capacity. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = narrow(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(digest_long(text, seed=7), F.lit(buckets)).cast("int").alias("bucket"),
    )
    rows = cut(rows, "sizes").withColumn("row", F.monotonically_increasing_id())  # numbers of a written table
    groups = cut(rows.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "buckets")
    cuts = minimax_cuts(groups, shards)[1]
    shard = sum((F.when(F.col("bucket") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.select("bucket", shard.cast("int").alias("shard"), "n", F.ceil(F.sqrt("n")).alias("cells"))
    placed = placed.select("bucket", "shard", "cells", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bucket_at"))
    # At most ``buckets`` rows of 24 bytes at any input size.
    rows = rows.join(F.broadcast(placed), "bucket").withColumn("cell", F.pmod(digest_long("row", seed=8), F.col("cells")))
    inside = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("bucket", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("bucket", "cell", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("cell_at"))
    order = Window.partitionBy("bucket", "cell").orderBy("row")
    rows = rows.join(cells, ["bucket", "cell"]).withColumn("rank", F.row_number().over(order))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("bucket_at") + F.col("cell_at") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
