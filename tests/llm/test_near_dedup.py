import random

import numpy as np
import pytest

from corvane.llm import components, near_dedup
from corvane.llm.near_dedup import dart_signatures, near_classes, shingles


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(" ".join((t or "").split(" ")), []).append(i)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = [(i, shingle_set(t), t or "") for i, t in rows]
    for n, (i, a, t) in enumerate(items):
        for j, b, u in items[n + 1 :]:
            if t == u or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.choice([6, 40, 120, 400]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    shared = " ".join(word() for _ in range(60))
    rows += [(len(rows) + k, shared + " " + " ".join(word() for _ in range(25))) for k in range(40)]
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "ONE two"), (n + 4, "one"), (n + 5, rows[0][1]), (n + 6, rows[0][1].replace(" ", "\n\t"))]


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 4)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, class_id int, Text string").repartition(3)
    found = near_classes(df).collect()
    expected = brute([(i, " ".join((t or "").split())) for i, t in rows])
    assert {r.doc_id: r.class_id for r in found} == expected and len(found) == len(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in found)
    kept = near_dedup.keep_one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(set(expected.values()))


def test_repeated_rows_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z"), (3, None)], "doc_id long, text string")
    found = sorted((tuple(r)[:3] for r in near_classes(df).collect()), key=repr)
    assert found == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (3, 3, True)], key=repr)
    assert near_classes(df.limit(0)).count() == 0


def test_repeated_ids_with_different_texts(spark):
    """An id's texts are nodes of their own: one may be a copy, another linked, a third like nothing, and each stays or goes alone."""
    rng = random.Random(7)
    base = " ".join(str(rng.randint(0, 10**6)) for _ in range(80))
    other, third = (" ".join(str(rng.randint(0, 10**6)) for _ in range(80)) for _ in range(2))
    rows = [(3, other), (5, other), (5, base), (9, base + " end"), (5, third), (None, base + " fin"), (None, third), (None, "alone"), (5, base), (5, "one two"), (4, "one  two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((tuple(r) for r in near_classes(df).select("doc_id", "class_id", "kept").collect()), key=repr)
    expected = [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (5, 5, True), (None, 5, False), (None, 5, False), (None, None, True), (5, 5, True), (5, 4, False), (4, 4, True)]
    assert found == sorted(expected, key=repr)
    stay = sorted(near_dedup.keep_one_of_each(df).collect(), key=repr)
    assert [tuple(r) for r in stay] == sorted([r for r, e in zip(rows, expected) if e[2]], key=repr)


def test_weighted(spark):
    """Weighted, a line that stands there five times is not the line once; in sets it is."""
    line = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, line), (2, f"{line} {line}"), (3, f"{line} {line} {line}"), (4, " ".join([line] * 30)), (5, " ".join([line] * 29))], "doc_id long, text string")
    counted = {}
    for r in df.collect():
        w = r.text.split()
        counted[r.doc_id] = {}
        for i in range(len(w) - 4):
            key = tuple(w[i : i + 5])
            counted[r.doc_id][key] = counted[r.doc_id].get(key, 0) + 1
    like = lambda a, b: sum(min(a.get(k, 0), b.get(k, 0)) for k in a) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    linked = {(a, b) for a in counted for b in counted if a < b and like(counted[a], counted[b]) >= 0.8}
    assert linked == {(4, 5)}
    assert {r.doc_id: r.class_id for r in near_classes(df, weighted=True).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    assert {r.doc_id: r.class_id for r in near_classes(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


def test_templates_and_chains(spark, monkeypatch):
    """A passage that many texts share, chains of near copies whose ends differ, and blocks of a few members."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for share in (60, 75, 85, 95):
        passage = [word() for _ in range(share)]
        rows += [(len(rows) + k, " ".join(passage + [word() for _ in range(100 - share)])) for k in range(30)]
    for _ in range(3):
        text = [word() for _ in range(150)]
        for k in range(25):
            text = list(text)
            text[(k * 7) % 150] = word()
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.class_id for r in near_classes(df).collect()} == brute(rows)


def test_recall_by_similarity(spark, capsys):
    """Of pairs of texts that are like no other, by similarity: the share that is linked."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    rows, pairs = [], []
    for _ in range(600):
        a = [word() for _ in range(rng.randint(60, 300))]
        b = list(a)
        for _ in range(rng.randint(1, max(1, len(a) // 40))):
            b[rng.randrange(len(b))] = word()
        x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        pairs.append((len(rows), len(x & y) / len(x | y)))
        rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    found = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bands = {}
    for i, like in pairs:
        bands.setdefault(min(int(like * 20) / 20, 0.95), []).append(found[i + 1] == i)
    with capsys.disabled():
        print("\nnear_classes, share of pairs linked by similarity:", {k: (round(sum(v) / len(v), 3), len(v)) for k, v in sorted(bands.items())})
    for like, linked in bands.items():
        assert sum(linked) >= 0.9 * len(linked) if like >= 0.8 else not any(linked)


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    element = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0.2, 4, 300), rng.uniform(0.2, 4, 300)
    of = np.repeat([0, 1], 300)
    s = dart_signatures(of, np.concatenate([element, element]), np.concatenate([a, b]), 2, 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    t = dart_signatures(np.repeat([0, 1], [300, 200]), np.concatenate([element, element[100:]]), None, 2, 4000)
    assert abs((t[0] == t[1]).mean() - 2 / 3) < 0.03
    of, one = shingles(["only", ""])
    assert (dart_signatures(of, one, None, 2, 50)[0] != 0).all() and not dart_signatures(of, one, None, 2, 50)[1].any()


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: find(i) for i in root if find(i) != i}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_shingles_throw_no_more_darts_than_one(monkeypatch):
    """A text of one line many times has the signature of the line, at the cost of its distinct shingles."""
    once, often = "one line of a few more words " * 3, "one line of a few more words " * 4000
    thrown = []
    real = near_dedup._mix
    monkeypatch.setattr(near_dedup, "_mix", lambda x: thrown.append(len(x)) or real(x))
    of, element = shingles([once, often])
    signature = dart_signatures(of, element, None, 2)
    assert (signature[0] == signature[1]).all()
    assert max(thrown) <= len(element) + 10
