import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import sharding


def smallest(sizes, shards):
    def fits(c):
        n, load = 1, 0
        for x in sizes:
            if load + x > c:
                n, load = n + 1, 0
            load += x
        return n <= shards

    c = max(sizes, default=0)
    while not fits(c):
        c += 1
    return c


@given(st.lists(st.integers(1, 60), min_size=0, max_size=25), st.integers(1, 6))
@settings(max_examples=15, deadline=None)
def test_capacity_is_minimax(spark, sizes, shards):
    groups = spark.createDataFrame([(3 * i, x) for i, x in enumerate(sizes)], "bucket int, bytes long").repartition(3)
    capacity, cuts = sharding.minimax_cuts(groups, shards)
    assert capacity == smallest(sizes, shards) or (not sizes and capacity == 0)
    loads = defaultdict(int)
    for i, x in enumerate(sizes):
        loads[sum(c <= 3 * i for c in cuts)] += x
    assert len(cuts) < shards and all(v <= capacity for v in loads.values())


@pytest.mark.parametrize("buckets", [1 << 16, 7])
def test_shards(spark, buckets):
    rng = random.Random(4)
    texts = ["hot text"] * 400 + ["t" * rng.randint(0, 300) + str(i % 150) for i in range(600)] + [None, "", "é" * 5000]
    rows = list(enumerate(texts)) + [(3, "hot text"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, size int, bucket string").repartition(6)
    out = sharding.shard_by_bytes(df, buckets=buckets).collect()
    raw = lambda t: (t or "").encode()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=repr) == sorted(((i, len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t in rows), key=repr)
    slots, of_text, text = defaultdict(list), defaultdict(set), dict(rows)
    for r in out:
        assert 0 <= r.shard < 8 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        of_text[raw(text[r.doc_id])].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0
