import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import whitening
from corvane.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string, EMBEDDING int"


def brute(rows, components, scale=64, shift=1_000_000):
    """By length of vectors: n, sums, eigenvalues, eigenvectors, trace, and the kept rows."""
    spaces = defaultdict(list)
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            spaces[len(v)].append((i, tuple(math.floor(scale * float(np.float32(c))) + shift for c in v)))
    out = {}
    for d, kept in spaces.items():
        fit = sorted({x for _, x in kept})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit]).reshape(n, d)
        values, vectors = np.linalg.eigh(centred.T @ centred / n) if d else (np.zeros(0), np.zeros((0, 0)))
        out[d] = n, sums, values[::-1], vectors[:, ::-1].T, float(values.sum()), kept
    return out


def check(rows, vectors, components=16):
    spaces = brute(vectors, components)
    by_key = defaultdict(list)
    for r in rows:
        by_key[r.vec_id, r.deviation, r.component].append(r)
    assert len(rows) == sum(len(s[5]) * min(components, d) for d, s in spaces.items())
    for d, (n, sums, values, basis, trace, kept) in spaces.items():
        m = min(components, d)
        signs = {}
        for i, x in kept:
            deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            centred = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)])
            for k in range(m):
                r = by_key[i, deviation, k + 1].pop()
                assert r.n == n
                if values[k] <= 1e-9 * max(values[0], 1e-300):
                    assert r.whitened is None
                    continue
                assert r.explained == pytest.approx(values[k] / trace, rel=1e-9)
                assert r.identity_error < 1e-9
                expected = float(centred @ basis[k]) / math.sqrt(values[k])
                if abs(expected) > 1e-3:
                    sign = signs.setdefault(k, math.copysign(1, expected * r.whitened))
                    assert sign * r.whitened == pytest.approx(expected, rel=1e-6, abs=1e-8)
                else:
                    assert abs(r.whitened) < 2e-3


@pytest.mark.parametrize("d", [5, 20])
def test_whiten(spark, d):
    rng = np.random.default_rng(d)
    spread = np.geomspace(9, 0.3, d)
    vectors = [(i, [float(c) for c in rng.normal(0, spread) @ np.linalg.qr(np.random.default_rng(1).normal(size=(d, d)))[0]]) for i in range(300)]
    vectors += [(i, vectors[0][1]) for i in range(300, 500)]  # a hot vector
    vectors += [(None, vectors[1][1]), (3, vectors[2][1]), (600, None), (601, []), (602, [float("nan")] * d), (603, [None] * d), (604, [float("inf")] + [0.0] * (d - 1))]
    df = spark.createDataFrame([(*v, 1, "x", 2) for v in vectors], SCHEMA).repartition(11)
    check(whitening.whiten(df).collect(), vectors)
    assert whitening.whiten(df.limit(0)).count() == 0


def test_little_data(spark):
    rows = lambda *v: spark.createDataFrame([(i, x, 1, "x", 2) for i, x in enumerate(v)], SCHEMA)
    one = whitening.whiten(rows([1.0, 2.0], [1.0, 2.0])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    line = whitening.whiten(rows([1.0, 2.0, 5.0], [2.0, 2.0, 5.0], [4.0, 2.0, 5.0])).collect()
    assert [r.whitened is None for r in sorted(line, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 3
    assert all(r.explained == (1.0 if r.component == 1 else 0.0) and r.identity_error < 1e-12 for r in line)
    mixed = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 4.0, 2.0]), (4, [3.0, 3.0, 0.0]), (5, [0.0, 1.0, 5.0]), (6, [1.0, 0.0, 0.5])]
    check(whitening.whiten(rows(*[v for _, v in mixed])).collect(), mixed)


@given(st.integers(1, 6), st.lists(st.integers(1, 9), min_size=1, max_size=6), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_merging_loses_nothing(d, sizes, seed):
    x = np.random.default_rng(seed).integers(-50, 50, (sum(sizes), d)) + 1_000_000
    factors = [whitening.Factor.of(part) for part in np.split(x, np.cumsum(sizes)[:-1])]
    merged = factors[0].merged(*factors[1:]) if len(factors) > 1 else factors[0]
    centred = x - x.mean(0)
    assert merged.n == len(x) and (merged.sums == x.sum(0)).all()
    assert merged.rows.shape[0] <= max(d, 1)
    np.testing.assert_allclose(merged.rows.T @ merged.rows, centred.T @ centred, atol=1e-6 * len(x))


def test_deviations_beyond_64_bits():
    model = whitening.Whitener(10**9, np.array([3 * 10**15, 10**15]), np.eye(2), np.ones(2), np.ones(2))
    x = [10**6 + 10**8, 10**6 - 7]
    centred = model.centred(np.array([x]))
    assert int(model.deviations(centred)[0].as_py()) == sum((10**9 * c - s) ** 2 for c, s in zip(x, [3 * 10**15, 10**15])) > 2**63


def test_large_entries(spark):
    vectors = [(i, [float(1 << 46) * (i % 5 - 2), float(i)]) for i in range(200)]
    check(whitening.whiten(spark.createDataFrame([(*v, 1, "x", 2) for v in vectors], SCHEMA).repartition(3)).collect(), vectors)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    vectors = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = op12_whitening(spark, folder)
    assert dict(out.dtypes)["deviation"] == "bigint"
    check(out.collect(), vectors)
