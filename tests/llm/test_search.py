import numpy as np

from corvane.llm import vector_search as v
from corvane.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, asked, k=5):
    ids = np.array([r[0] for r in rows])
    m = np.floor(256 * np.array([r[1] for r in rows], float)).astype(np.int64)
    out = set()
    for q in asked:
        at = int(np.flatnonzero(ids == q)[0])
        s = m @ m[at]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out |= {(int(q), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)}
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(v, "BLOCK", 8)
    monkeypatch.setattr(v, "CANDIDATES", 32)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(90)] + [(2000 + i, [0.0] * 6) for i in range(20)]
    odd = [(5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5002, [float("nan")] * 6), (5003, [float("inf")] * 6), (None, [9.0] * 6), (5004, [])]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows + odd], "vec_id long, embedding array<float>, score int, rank int").repartition(7)
    asked = [r[0] for r in rows if r[0] % 10 == 0]
    rows = [(i, np.array(e, np.float32)) for i, e in rows]
    assert {tuple(r) for r in v.search(df, df.filter("vec_id % 10 = 0")).collect()} == brute(rows, asked)


def test_few_candidates_and_other_lengths(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0]), (3, [3e38, -3e38]), (3, [3e38, -3e38])], "vec_id long, embedding array<float>")
    found = {tuple(r) for r in v.search(df, df.filter("vec_id in (0, 2)")).collect()}
    big = int(np.floor(256.0 * float(np.float32(3e38))))
    assert (0, 1, 1, 256 * 256 * 5) in found and len(found) == 2 and big > 2**63
    assert (0, 2, 3, -(2**63)) in found
    assert v.search(df.limit(0), df).count() == 0 and v.search(df, df.limit(0)).count() == 0


def test_query(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding) for r in e]
    found = {(r.query_id, r.rank, r.vec_id, r.score) for r in QUERIES["op3_vector_search"](spark, SF).collect()}
    assert found == brute(rows, [r[0] for r in rows if r[0] % 50 == 0])
