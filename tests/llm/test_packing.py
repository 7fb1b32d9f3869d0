import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import packing
from corvane.llm.queries import tokenizer_path
from corvane.llm.tokens import ChunkTokenizer

SCHEMA = "doc_id long, text string, bin int, fill string, TEXT string"


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=100, deadline=None)
def test_best_fit(lengths):
    bins, offsets, fills = packing.best_fit(np.array(lengths, np.int64), 50)
    for b in range(len(fills)):
        own = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at == fills[b] <= 50
    assert len(fills) <= 1 or sorted(fills)[0] + sorted(fills)[1] > 50


@pytest.fixture(scope="module")
def tokenizer():
    return ChunkTokenizer(tokenizer_path())


@given(st.lists(st.sampled_from(["don't", '"they\'ll"', "É", "İs", "ß", "ﬁne", "a\x1cb", "x y", "<|endoftext|>", "<|ENDOFTEXT|>b,", "12.5%", "...", "'s", "n't'", "日本語。", "a" * 60, "word',", "é.", "»,", "́x", " ", "\n"]), max_size=8))
@settings(max_examples=300, deadline=None)
def test_chunks_equal_the_whole_text(tokenizer, parts):
    for glue in ("", " "):
        text = glue.join(parts)
        ids = np.frombuffer(next(iter(tokenizer.ids([text.encode()]))), "<u4").tolist()
        assert ids == tokenizer.whole.encode(text, add_special_tokens=False).ids


def test_pack(spark, tokenizer):
    texts = ["", None, "one two", "one two", "x " * 9000, "word " * 4095, "a", " \n"] + [f"text {i} " * (i % 97) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in enumerate(texts)] + [(None, "no id", 1, "x", "y")], SCHEMA).repartition(20)
    rows = packing.pack(docs, tokenizer_path()).collect()
    expected = set()
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids = tokenizer.whole.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a : a + 4096], "<u4")
            expected.add((i, k, a, len(part), zlib.crc32(part.tobytes())))
    assert {tuple(r)[:5] for r in rows} == expected and len(rows) == len(expected)
    total = sum(r.length for r in rows)
    assert sequences(rows) <= -(-total // 4096) + 2
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_no_pair_fits(spark):
    docs = spark.createDataFrame([(i, "a b " * 1100) for i in range(40)], "doc_id long, text string").repartition(8)
    for settings_ in ({}, {"leaf": 4, "fan": 2}):
        rows = packing.pack(docs, tokenizer_path(), **settings_).collect()
        assert len(rows) == 40 and len({r.sequence_id for r in rows}) == 40


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(max_examples=200, deadline=None)
def test_runs_equal_best_fit(lengths):
    lengths = np.array(lengths, np.int64)
    runs, groups, made = packing.best_fit_runs({int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}, 50)
    rank = np.array([(lengths[:i] == n).sum() for i, n in enumerate(lengths)], np.int64)
    bins, offsets = packing.placed(runs, lengths, rank)
    fills = np.bincount(bins, lengths, made).astype(int)
    assert sorted(fills) == sorted(packing.best_fit(lengths, 50)[2])
    assert sorted(fills[fills < 50]) == sorted(f for f, _, n in groups.tolist() for _ in range(n))
    assert all((fills[b : b + n] == f).all() for f, b, n in groups.tolist())
    for b in range(made):
        at = 0
        for o, n in sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b)):
            assert o == at
            at += n


def sequences(rows, capacity=4096):
    """The number of sequences, whose pieces must follow each other without gaps."""
    found = {}
    for r in rows:
        found.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in found.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(found)


def test_partitions_of_unlike_lengths(spark):
    """More bins that wait for their other half than one node used to pass on, in partitions of long and of short pieces."""
    rows = [(i, "a " * (2060 + i % 140)) for i in range(800)] + [(1000 + i, "a " * (1800 + i % 150)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartitionByRange(4, "doc_id")
    found = packing.pack(docs, tokenizer_path()).collect()
    lengths = np.array([r.length for r in found], np.int64)
    assert len(found) == 1600 and len({r.sequence_id for r in found}) == len(packing.best_fit(lengths, 4096)[2]) == 800


@pytest.mark.parametrize("lengths", [
    [2060 + i % 140 for i in range(800)] + [1800 + i % 150 for i in range(800)],
    [2999] * 700 + [999] * 700,
    [3071] * 600 + [1023] * 600,
    sorted((i * 7919) % 3000 + 1 for i in range(2000)),
    sorted(1000 + (i * 7919) % 900 for i in range(2000)),
    [i % 5 for i in range(2000)],
])
def test_tree_of_small_leaves(spark, lengths):
    """Sorted tables in many leaves and several levels: few more sequences than best fit over all, though leaves are a hundredth of the usual ones."""
    docs = spark.createDataFrame([(i, "a " * n) for i, n in enumerate(lengths)], "doc_id long, text string").coalesce(1).repartitionByRange(4, "doc_id")
    found = packing.pack(docs, tokenizer_path(), leaf=300, fan=2).collect()
    assert sorted((r.doc_id, r.length) for r in found) == [(i, n + 1) for i, n in enumerate(lengths)]
    assert max(r.sequence_id >> 58 for r in found) >= 2
    best = len(packing.best_fit(np.array(lengths, np.int64) + 1, 4096)[2])
    assert sequences(found) <= best + max(1, best // 33)
