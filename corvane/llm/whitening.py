"""Whitening of embeddings by hierarchical merging of singular value decompositions.

A task reads its vectors in batches and keeps, for all it has read, a number,
the exact sums and the singular values times right vectors of the centred rows,
at full rank. Two such factors are merged by stacking them with one more row,
the difference of their means times sqrt(a * b / (a + b)), and decomposing
again, which loses nothing. Factors of tasks merge up a tree of groups of
``FAN``; the root's right vectors are the components, its squared singular
values over the number the variances. No covariance is ever summed up, so that
small variances beside large means or other variances keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, narrow

#: Children of a node of the merge tree. Singular values below this share of the largest are none.
FAN, NOTHING = 8, 1e-12

_FACTOR = "dims int, node long, n long, sums array<long>, factor array<double>"


@dataclass
class Factor:
    """Number and exact sums of some vectors, and rows with the same scatter about the mean."""

    n: int
    sums: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Factor:
        """Of integer vectors; centred exactly, before anything is multiplied."""
        n, whole = len(x), _roomy(x, len(x))
        sums = whole.sum(0)
        return cls(n, sums, _reduced(((n * whole - sums) / n).astype(np.float64)))

    def merged(self, *others: Factor) -> Factor:
        """Together with others: one decomposition of all rows and the corrections of the means."""
        n, sums, rows = self.n, self.sums, [self.rows]
        for o in others:
            # Python's integers: the means' difference is rounded once.
            apart = [(int(a) * o.n - int(b) * n) / (n * o.n) for a, b in zip(sums, o.sums)]
            rows += [o.rows, np.sqrt(n / (n + o.n) * o.n) * np.array([apart])]
            n, sums = n + o.n, sums + o.sums
        return Factor(n, sums, _reduced(np.concatenate(rows)))


def _roomy(x: np.ndarray, n: int) -> np.ndarray:
    """Whole numbers, n times which don't overflow: Python's where 64 bits don't do."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    return x if 2 * n * most < 2**62 else x.astype(object)


def _reduced(rows: np.ndarray) -> np.ndarray:
    """As many rows as dimensions at most, with the same products: singular values times right vectors."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def _matrices(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of an array of vectors: each length, the places of its vectors, and those as a matrix."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        starts = vectors.offsets.to_numpy()[at] - vectors.offsets[0].as_py()
        yield int(d), at, flat[starts[:, None] + np.arange(d)]


def _factors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each length of vectors in a partition."""
    node, found = TaskContext.get().partitionId(), {}
    for batch in batches:
        for d, _, x in _matrices(batch.column(0)):
            own = Factor.of(x)
            found[d] = found[d].merged(own) if d in found else own
    if found:
        yield pa.RecordBatch.from_pandas(pd.DataFrame([(d, node, f.n, f.sums, f.rows.ravel()) for d, f in found.items()], columns=["dims", "node", "n", "sums", "factor"]), schema=pa.schema([("dims", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("factor", pa.list_(pa.float64()))]), preserve_index=False)


def _read(row) -> Factor:
    return Factor(int(row.n), np.array(row.sums, np.int64), np.array(row.factor, np.float64).reshape(-1, int(row.dims)))


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """The factors of a node's children, merged in their order."""
    first, *others = [_read(r) for r in rows.sort_values("child").itertuples()]
    out = first.merged(*others) if others else first
    return pd.DataFrame({"dims": rows["dims"].iloc[:1].to_numpy(), "node": rows["node"].iloc[:1].to_numpy(), "n": [out.n], "sums": [out.sums], "factor": [out.rows.ravel()]})


@dataclass
class Whitener:
    """Components of the vectors of one length, by falling variance, and their shares of it."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @classmethod
    def of(cls, factor: Factor, components: int) -> Whitener:
        _, s, vt = np.linalg.svd(factor.rows, full_matrices=False)
        at = np.arange(len(s))
        vt = vt * np.sign(vt[at, np.abs(vt).argmax(1)])[:, None]  # the largest entry is positive
        dims = len(factor.sums)
        variances, total = np.zeros(dims), (s * s).sum()
        variances[: len(s)] = np.where(s > NOTHING * s[0], s * s, 0) / factor.n
        m = min(components, dims)
        full = np.zeros((m, dims))
        full[: len(vt)] = vt[:m]
        return cls(factor.n, factor.sums, full, variances[:m], variances[:m] / (total / factor.n) if total else np.full(m, np.nan))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        return self.n * _roomy(x, self.n) - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """The projections over their deviations; nan where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > 0, (centred / self.n).astype(np.float64) @ self.components.T / np.sqrt(self.variances), np.nan)

    def deviations(self, centred: np.ndarray) -> pa.Array:
        """Sums of squares as exact decimals."""
        most = max(int(np.abs(centred).max(initial=0)), 1)
        if most * most * centred.shape[1] < 2**63:
            return pa.array((centred * centred).sum(1).astype(np.int64)).cast(pa.decimal128(38, 0))
        return pa.array([Decimal(sum(int(v) ** 2 for v in row)) for row in centred], pa.decimal128(38, 0))


def integer_vectors(vectors: DataFrame, scale: int, shift: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(scale * c) + shift of every entry; vectors that are null, or hold null or non-finite entries, go."""
    rows = narrow(vectors, vec_id=id_col, v=vector_col)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))

    def finite(c: Column) -> Column:
        return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))

    rows = rows.filter(F.col("v").isNotNull() & F.forall("v", finite))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(scale * c) + shift).cast("array<long>").alias("x"))


def fit(distinct: DataFrame, components: int) -> dict[int, Whitener]:
    """Whiteners by length of vectors, from a column x of vectors that is a written table."""
    factors = cut(distinct.select("x").mapInArrow(_factors, _FACTOR), "factors")
    last = factors.agg(F.max("node")).first()[0]
    while last:  # none, or the root
        nodes = factors.withColumn("child", F.col("node")).withColumn("node", F.expr(f"node div {FAN}"))
        factors = cut(nodes.groupBy("dims", "node").applyInPandas(_merge, _FACTOR), "factors")
        last //= FAN
    # One row for each length of vectors, of that length squared.
    return {r.dims: Whitener.of(_read(r), components) for r in factors.collect() if r.dims}


def _products(models: dict[int, Whitener]):
    """Sums of whitened values and of their products, by length of vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch.column(0)):
                if d in models:
                    w = np.nan_to_num(models[d].whitened(models[d].centred(x)))
                    w = np.concatenate([np.ones((len(w), 1)), w], 1)
                    sums[d] = sums.get(d, 0) + w.T @ w
        for d, s in sums.items():
            i, j = np.indices(s.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s.ravel())], names=["dims", "i", "j", "v"])

    return run


def measure(models: dict[int, Whitener], distinct: DataFrame) -> None:
    """Set each model's identity_error from the whitened vectors themselves."""
    rows = distinct.select("x").mapInArrow(_products(models), "dims int, i int, j int, v double")
    sums: dict[int, dict] = {d: {} for d in models}
    for r in rows.groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).collect():  # (components + 1) squared rows a length
        sums[r.dims][r.i, r.j] = r.v
    for d, model in models.items():
        size = len(model.components) + 1
        s = np.array([[sums[d][i, j] for j in range(size)] for i in range(size)]) / model.n
        covariance = s[1:, 1:] - np.outer(s[0, 1:], s[0, 1:])
        kept = model.variances > 0
        off = np.abs(covariance - np.eye(size - 1))[np.ix_(kept, kept)]
        model.identity_error = float(off.max()) if off.size else None


_WHITE = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _project(models: dict[int, Whitener]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _matrices(batch.column(1)):
                if d not in models:
                    continue
                model = models[d]
                centred = model.centred(x)
                m, rows = len(model.components), len(at)
                of = pa.array(np.repeat(np.arange(rows), m))
                number = lambda v, kind: pa.array(np.tile(v, rows), kind, from_pandas=True)
                columns = [
                    batch.column(0).take(pa.array(at)).take(of), number(np.arange(1, m + 1), pa.int32()), pa.array(np.full(rows * m, model.n)), model.deviations(centred).take(of),
                    pa.array(model.whitened(centred).ravel(), from_pandas=True), number(model.explained, pa.float64()), pa.array([model.identity_error] * (rows * m), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each vector on the first components: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become floor(scale * c) + shift; vectors that are null, or hold null
    or non-finite entries, go; an entry that becomes no 64-bit number is an
    error. Components are fitted on every different vector once, n of them. ``deviation`` is the exact sum over dimensions of
    (n * x - sum)^2. Ids may be null and repeat: every row is whitened, equal
    vectors alike. Vectors of another length are a space of their own, with its
    own n; those of length 0 have no components and no rows. A component
    without variance has null ``whitened``, and null ``explained`` if nothing
    varies; identity_error is over the others, null without any. Components of
    equal variance are any basis of their space. An empty table gives no rows;
    other columns are ignored.
    """
    bounded_batches(vectors.sparkSession)
    rows = integer_vectors(vectors, scale, shift, id_col, vector_col)
    distinct = cut(rows.select("x").distinct(), "distinct")
    models = fit(distinct, components)
    measure(models, distinct)
    # A model is components times dimensions.
    return rows.mapInArrow(_project(models), _WHITE)
