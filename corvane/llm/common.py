"""What the operators of this subpackage share: narrowing, cutting lineage, sizes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..shipping import ship

#: Runs of ASCII white space, as the contracts spell it.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, new=old, found by their exact name.

    Extra columns never matter, not even when they repeat a name, differ from
    one by case only, or are called like a column that an operator adds.
    """
    names = df.columns
    missing = [old for old in wanted.values() if old not in names]
    if missing:
        raise ValueError(f"no column {missing} among {names}")
    flat = df.toDF(*[f"_{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_{names.index(old)}").alias(new) for new, old in wanted.items()])


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/corvane-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back.

    This cuts the lineage as ``checkpoint()`` does, survives the loss of
    executors, and keeps columns prunable and sizes known to the optimizer.
    """
    spark = df.sparkSession
    ship(spark)
    path = new_folder(spark, name)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The tables written in each scratch that is open.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the tables that are cut within: what is needed longer is written to a folder of its own."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The same, and the number of rows, counted while they are written.

    Where lost executors make tasks run again it may come out too high, never
    too low: it tells empty tables and sizes partitions.
    """
    seen = Observation()
    written = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return written, seen.get["n"]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Ready the session for Python steps over whole texts: the package shipped, Arrow batches held to some bytes where it has Spark's default of 64 MB."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(most))


def digest_long(*columns: Column | str, seed: int = 0) -> Column:
    """A 64-bit hash of columns, equal in every run."""
    return F.xxhash64(F.lit(seed), *columns)


#: What this worker process holds for tasks to come, by owner: how to let go of it.
_HELD: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None] | None = None) -> None:
    """Begin work for an owner: what other operators keep in this worker is released, and freed memory goes back to the system.

    Worker processes outlive tasks, so that caches serve many of them; without
    this the caches of every operator that ever ran would add up.
    """
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    if release is not None:
        _HELD[owner] = release
    if others:
        trim()


def trim() -> None:
    """Give freed memory back."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def runs(sizes: list[int], most: int, count: int) -> Iterator[slice]:
    """Slices of consecutive items whose sizes sum to no more than the most, or of a single item, and of so many at most."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > most or i - start >= count):
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))
