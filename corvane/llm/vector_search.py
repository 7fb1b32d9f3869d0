"""Exact top-k search by inner product over vector-approximation files.

Components are scaled to whole numbers and each dimension is quantised into 64
cells, so that a vector is approximated by a byte a dimension. Queries scan the
cells of a partition for bounds of every score, then read exact vectors from
the highest bound down until no bound reaches the kth score found. (An inner
product's upper bound plays the part that a distance's lower bound plays.)
Equal vectors are one candidate with their smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, claim, cut, digest_long, narrow

SCALE, CELLS = 256.0, 64
#: Queries broadcast at once, queries scored at once by a task, candidates scanned at once, exact vectors read at once.
BLOCK, QUERIES, CANDIDATES, READ = 8192, 256, 4096, 32


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as floor(SCALE * x)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values.reshape(len(column), -1))


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    widths = pa.compute.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        if width > 0:
            yield batch.filter(pa.array(widths == width))


def _distinct(k: int):
    """Equal vectors of a partition as one row with their k + 1 smallest ids, and the range of each dimension beside."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _by_width(batch, 1):
                found: dict[bytes, list[int]] = {}
                for row, i in zip(_matrix(some.column(1)), some.column(0).to_pylist()):
                    found.setdefault(row.tobytes(), []).append(i)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([sorted(set(v))[: k + 1] for v in found.values()], pa.list_(pa.int64()))], names=["vector", "ids"])

    return run


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = batch.column(0).to_pylist()
        for width in {len(r) for r in rows}:
            m = np.frombuffer(b"".join(r for r in rows if len(r) == width)).reshape(-1, width // 8)
            frame = pd.DataFrame({"width": width // 8, "dim": np.arange(width // 8), "low": m.min(0), "high": m.max(0)})
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)


def _approximate(grids: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Add the cells of each vector: the approximation file's part of the row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for v in batch.column(0).to_pylist():
                x = np.frombuffer(v)
                low, step = grids[len(x)]
                cells.append(np.clip(np.floor((x - low) / step), 0, CELLS - 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), batch.column(0), batch.column(1)], names=["cells", "vector", "ids"])

    return run


def _exact(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Whole inner products, exact, held to 64 bits."""
    if np.abs(query).max(initial=0) * np.abs(vectors).max(initial=0) * len(query) < 2.0**52:
        return (vectors @ query).astype(np.int64).tolist()
    whole = [int(x) for x in query]
    return [max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(v, whole)))) for v in vectors]


class _Scan:
    """The k best of each query over the candidates seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = ids, queries, k
        self.plus, self.minus = queries.clip(0), queries.clip(None, 0)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), in order
        self.kth = np.full(len(ids), -np.inf)

    def add(self, low: np.ndarray, high: np.ndarray, vectors: list[bytes], members: list[list[int]]) -> None:
        for at in range(0, len(self.ids), QUERIES):
            part = slice(at, at + QUERIES)
            upper = self.plus[part] @ high.T + self.minus[part] @ low.T
            lower = self.plus[part] @ low.T + self.minus[part] @ high.T
            slack = np.abs(self.queries[part]).sum(1) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * 2.0**-48
            upper += slack[:, None]
            # One more than k: the query's own row may be among them.
            enough = np.partition(lower, -self.k - 1, 1)[:, -self.k - 1] - slack if lower.shape[1] > self.k else -np.inf
            reach = upper >= np.maximum(self.kth[part], enough)[:, None]
            for q in np.flatnonzero(reach.any(1)):
                self._visit(at + q, upper[q], np.flatnonzero(reach[q]), vectors, members)

    def _visit(self, q: int, upper: np.ndarray, reached: np.ndarray, vectors: list[bytes], members: list[list[int]]) -> None:
        best, own, k = self.best[q], self.ids[q], self.k
        order = reached[np.argsort(-upper[reached], kind="stable")]
        for at in range(0, len(order), READ):
            if len(best) >= k and upper[order[at]] < -best[k - 1][0]:
                break  # no unread vector can reach the kth score
            some = order[at : at + READ]
            read = np.stack([np.frombuffer(vectors[i]) for i in some])
            for i, score in zip(some, _exact(read, self.queries[q])):
                if len(best) < k or -score <= best[k - 1][0]:
                    best.extend((-score, m) for m in members[i] if m != own)
                    best.sort()
                    del best[k:]
        if len(best) >= k:
            self.kth[q] = -best[k - 1][0]


def _search(shared, grids: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("vector_search")
        scans = {w: _Scan(ids, q, k) for w, (ids, q) in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                some = batch.slice(at, CANDIDATES)
                cells, vectors, members = (some.column(i).to_pylist() for i in range(3))
                widths = np.array([len(c) for c in cells])
                for width in np.unique(widths):
                    if width in scans:
                        own = np.flatnonzero(widths == width)
                        low, step = grids[width]
                        code = np.frombuffer(b"".join(cells[i] for i in own), np.uint8).reshape(len(own), width)
                        scans[width].add(low + code * step, low + (code + 1.0) * step, [vectors[i] for i in own], [members[i] for i in own])
        rows = [(int(i), m, -s) for scan in scans.values() for i, best in zip(scan.ids, scan.best) for s, m in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest scores among the vectors: query_id, rank, vec_id, score.

    The score is the integer inner product of floor(256 * component); ties go
    to the smaller id, and fewer than k candidates are all returned. An id
    names its vector: rows with a query's own id are no candidates for it, and
    repeated rows count once. Rows without id, and vectors that are null,
    empty or hold null or non-finite components, take no part; vectors of
    another length than the query's are no candidates. Scores beyond 64 bits
    are held at the last one. Empty tables give no rows; other columns are
    ignored.
    """
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def valid(df: DataFrame) -> DataFrame:
        df = narrow(df, id=id_col, v=vector_col).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
        return df.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(whole).filter(F.size("v") > 0)

    spark = vectors.sparkSession
    bounded_batches(spark)
    distinct = valid(vectors).mapInArrow(_distinct(k), "vector binary, ids array<long>").groupBy("vector").agg(F.collect_list("ids").alias("ids"))
    distinct = cut(distinct.select("vector", F.slice(F.array_sort(F.array_distinct(F.flatten("ids"))), 1, k + 1).alias("ids")), "distinct")
    # A row for each dimension that occurs.
    ranges = distinct.select("vector").mapInArrow(_ranges, "width long, dim long, low double, high double").groupBy("width", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    grids = {}
    for width, own in ranges.groupby("width"):
        own = own.sort_values("dim")
        low, high = own["low"].to_numpy(), own["high"].to_numpy()
        grids[int(width)] = (low, np.maximum(np.ceil((high - low + 1) / CELLS), 1.0))
    file = cut(distinct.mapInArrow(_approximate(grids), "cells binary, vector binary, ids array<long>"), "approximations")

    asked = cut(valid(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-asked.count() * 5 // (4 * BLOCK)))
    found = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(digest_long("id", seed=13), F.lit(blocks)) == b).toPandas()
        widths = rows["v"].map(len)
        block = {int(w): (own["id"].to_numpy(), np.floor(SCALE * np.stack(own["v"].to_list()).astype(np.float64))) for w, own in rows.groupby(widths)}
        part = file.mapInArrow(_search(spark.sparkContext.broadcast(block), grids, k), "query_id long, vec_id long, score long")
        part = cut(part, "best") if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
