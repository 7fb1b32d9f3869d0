"""Packing by power-of-two decomposition: every document is split into pieces of binary lengths.

A document of n tokens gives n // capacity pieces of the capacity and, for the
rest, one piece for each bit of it, the longest first. A piece is a sequence of
its own, so no sequence crosses documents and none needs padding; sequences of
equal length form a bucket, from which batches of as many tokens are taken. The
pieces of a task are numbered by bucket as they are made; counts by task and
bucket, a few rows a task, then give every sequence its place in its bucket. No
document and no bucket is ever gathered, whatever their sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_tokens import byte_tokenizer
from .common import bounded_batches, cut, narrow, runs, trim

CAPACITY, END_ID = 1024, 0
#: Tokens of a batch.
BATCH = 1 << 16
#: Texts tokenized at once, and bytes of them.
TEXTS, BYTES = 500, 1_500_000

_KINDS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "part": pa.int32(), "nth": pa.int64(), "ids": pa.binary()}
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long, ids binary"


def binary_lengths(n: int, capacity: int) -> list[int]:
    """The capacity as often as it fits, then the rest's powers of two, falling."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def _decompose(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = byte_tokenizer(path), np.array([end_id], "<u4").tobytes()
        part, made = TaskContext.get().partitionId(), dict.fromkeys((1 << i for i in range(capacity.bit_length())), 0)
        for batch in batches:
            doc_ids, whole = batch.column(0).to_pylist(), [t.as_py() or b"" for t in batch.column(1)]
            for part_of in runs([len(t) for t in whole], BYTES, TEXTS):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[part_of], tokenizer.ids(whole[part_of])):
                    ids += end
                    at, tokens = 0, len(ids) // 4
                    for n in binary_lengths(tokens, capacity):
                        piece = ids[4 * at : 4 * (at + n)]
                        rows.append((doc_id, at, n, zlib.crc32(piece), tokens, part, made[n], piece if keep_ids else None))
                        made[n] += 1
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS.values())], names=list(_KINDS))
        trim()

    return run


def decompose(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, batch_tokens: int = BATCH, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, slot, batch, and ids if kept.

    A document's ids are those of its whole text (null: empty) and the end id,
    so that every document has a piece. A piece is a sequence (offset 0) and its
    length, a power of two of at most the capacity, names its bucket. Slots
    number a bucket gaplessly from 0, batches of it hold ``batch_tokens`` tokens
    (at least one sequence), but for the last, and sequence ids number all
    sequences, shortest bucket first. ``ids`` are little-endian unsigned 32-bit
    numbers. Rows that repeat an id or a text are documents of their own, null
    ids are allowed, an empty table gives no rows and other columns are ignored.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError(f"a capacity of {capacity} is no power of two")
    bounded_batches(docs.sparkSession)
    rows = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    pieces = cut(rows.mapInArrow(_decompose(tokenizer, capacity, end_id, keep_ids), _PIECE), "pieces")
    # A row for each task and bucket.
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("slot_at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    lengths = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()  # a row for each power of two
    first = F.lit(0).cast("long")
    total = 0
    for bucket in lengths:
        first = F.when(F.col("length") == bucket["length"], F.lit(total)).otherwise(first)
        total += bucket["n"]
    at = counts.select(F.col("part").alias("_part"), F.col("length").alias("_length"), "slot_at")
    placed = pieces.join(at, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length")))
    placed = placed.withColumn("slot", F.col("slot_at") + F.col("nth")).withColumn("sequence_id", (first + F.col("slot")).cast("long"))
    each = F.greatest(F.lit(batch_tokens) / F.col("length"), F.lit(1)).cast("long")
    out = placed.withColumn("batch", F.floor(F.col("slot") / each).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "slot", "batch", *["ids"] * keep_ids)
