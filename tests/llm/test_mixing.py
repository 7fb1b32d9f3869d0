import random
import re
from collections import Counter, defaultdict

import pytest

from corvane.llm import mixing


def targets(sizes):
    """By resharing until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_plan(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rng = random.Random(seed)
    names = ["b", "a", "é", "z", None, "Z", "hot", "hot", "hot"]
    rows = [(i, rng.choice(names), " ".join("w" * (1 + j % 3) for j in range(rng.choice([0, 1, 5, 30, 200]))), 1, "s") for i in range(700)]
    rows += [(700, "a", None, 1, "s"), (701, "a", " x \t y", 1, "s"), (5, "b", "twice twice", 1, "s"), (5, "b", "twice twice", 1, "s"), (None, "b", "no id", 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, shard string").repartition(5)
    plan = mixing.mix_plan(df, seed=seed).collect()
    assert len(plan) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, s, t, *_ in rows:
        sizes[s] += size(t)
    expected, taken, largest = targets(sizes), Counter(), Counter()
    for r in plan:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken == r.size * r.copies <= 2 * r.size and len(r.shards) == r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in expected.items():
        assert 0 <= t - taken[s] <= largest[s] + 1
        left = [r.size for r in plan if r.source == s and r.size > 0 and r.copies < max(q.copies for q in plan if q.source == s)]
        assert t - taken[s] < min(left, default=10**9) + 1 or (5, 2) in {(r.doc_id, r.size) for r in plan if r.source == s}
    assert Counter((r.doc_id, r.size) for r in plan) == Counter((i, size(t)) for i, _, t, *_ in rows)
    again = mixing.mix_plan(df.repartition(3), seed=seed).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in plan)
    mixed = mixing.mix(df, seed=seed, in_shards=True)
    assert mixed.columns == [*df.columns, "shard"]
    copies = Counter()
    for r in plan:
        copies[r.doc_id, r.source, r.size] += r.copies
    assert Counter((r.doc_id, r.source, size(r.text)) for r in mixed.collect()) == +copies
    assert Counter(r[-1] for r in mixed.collect()) == Counter(x for r in plan for x in r.shards)
    assert mixing.mix(df, seed=seed).columns == df.columns


def test_tree_is_exact(spark):
    quotas = {i: q for i, q in enumerate([0, 1, 7, 100, 5000, 3])}
    df = spark.createDataFrame(list(quotas.items()), "sid long, quota long")
    rows = mixing.split_quotas(df, 5, seed=3).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        assert r.quota >= 0
        by_source[r.sid] += r.quota
        by_shard[r.shard] += r.quota
    assert all(by_source[s] == q for s, q in quotas.items())
    assert len(by_shard) == 5 and max(by_shard.values()) - min(by_shard.values()) <= 3


def test_draw_is_hypergeometric(spark):
    u = "((id + 0.5) / 4000)"
    found = Counter(r[0] for r in spark.range(4000).selectExpr(mixing._draw("5L", "20L", "8L", u)).collect())
    from math import comb

    for k in range(6):
        assert abs(found[k] / 4000 - comb(8, k) * comb(12, 5 - k) / comb(20, 5)) < 0.002


def test_empty_and_weightless(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", " ")], "doc_id long, source string, text string")
    assert {(r.doc_id, r.taken, r.target) for r in mixing.mix_plan(df).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
    assert mixing.mix_plan(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("same_text", [False, True])
def test_repeated_ids_take_no_more_than_the_plan(spark, same_text):
    rows = [(i // 10, "ab"[i % 2], "w " * (20 if same_text else 1 + i % 37)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan, mixed = mixing.mix_plan(df).collect(), mixing.mix(df).collect()
    assert len(mixed) == sum(r.copies for r in plan)
    words = Counter()
    for r in mixed:
        words[r.source] += len(r.text.split())
    for s in "ab":
        target = next(r.target for r in plan if r.source == s)
        assert words[s] == sum(r.taken for r in plan if r.source == s) and target - (100 if same_text else 2) <= words[s] <= target


def test_one_giant_document(spark, monkeypatch):
    """Small documents of later blocks fill what a document larger than the rest leaves."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 32)
    for seed in range(2):
        rows = [(i, "a", "w " * 30) for i in range(400)] + [(1000, "a", "w " * 24_000)] + [(2000 + i, "b", "w " * 30) for i in range(1200)]
        plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, source string, text string"), seed=seed).collect()
        for s in "ab":
            own = [r for r in plan if r.source == s]
            assert 0 <= own[0].target - sum(r.taken for r in own) < 31


def test_tree_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 4)
    quotas = {i: (i * 37) % 23 for i in range(70)}
    rows = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "sid long, quota long"), 3, seed=1).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r.sid] += r.quota
        by_shard[r.shard] += r.quota
        assert r.quota >= 0
    assert all(by_source[s] == q for s, q in quotas.items()) and len(by_shard) == 3 and max(by_shard.values()) - min(by_shard.values()) <= 2
