import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import decomposition
from corvane.llm.byte_tokens import ByteTokenizer
from corvane.llm.queries import op11_power_of_two, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part int, slot string, TEXT string"
PARTS = ["don't", '"they\'ll"', "É", "ß", "a\x1cb", "x y", "<|endoftext|>", "12.5%", "...", "'s", "n't'", "日本語。", " ", "　", " x", "\t", "  ", "\n", "\n\n", " \n", "a\nb", ".\nThe", "é", "»,", "word,", "A1", "᠎", "​", "\x85", "\r\n", "'", "naïve-té", "½", "x²", "a" * 70]


@pytest.fixture(scope="module")
def tokenizer():
    return ByteTokenizer(PATH)


@given(st.lists(st.sampled_from(PARTS), max_size=9), st.sampled_from(["", " ", "  "]))
@settings(max_examples=500, deadline=None)
def test_parts_equal_the_whole_text(tokenizer, parts, glue):
    text = glue.join(parts)
    ids = np.frombuffer(next(iter(tokenizer.ids([text.encode()]))), "<u4").tolist()
    assert ids == tokenizer.whole.encode(text, add_special_tokens=False).ids


@given(st.integers(0, 10**6), st.sampled_from([1, 2, 64, 1024]))
def test_binary_lengths(n, capacity):
    lengths = decomposition.binary_lengths(n, capacity)
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)
    assert all(x <= capacity and x & (x - 1) == 0 for x in lengths)
    small = [x for x in lengths if x < capacity]
    assert len(set(small)) == len(small)


def check(rows, docs, tokenizer, capacity, batch_tokens):
    found, slots, sequences = defaultdict(list), defaultdict(list), set()
    for r in rows:
        found[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        slots[r.length].append((r.slot, r.sequence_id, r.batch))
        sequences.add(r.sequence_id)
        assert r.offset == 0 and 0 < r.length <= capacity and r.length & (r.length - 1) == 0
    expected = defaultdict(list)
    for i, t in docs:
        ids = np.array([*tokenizer.whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n in decomposition.binary_lengths(len(ids), capacity):
            expected[i].append((at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    assert {i: sorted(p) for i, p in found.items()} == {i: sorted(p) for i, p in expected.items()}
    assert len(sequences) == len(rows) and (not rows or sequences == set(range(len(rows))))
    for length, own in slots.items():
        own.sort()
        assert [s for s, _, _ in own] == list(range(len(own)))
        assert [q - own[0][1] for _, q, _ in own] == list(range(len(own)))
        assert [b for _, _, b in own] == [s // max(batch_tokens // length, 1) for s, _, _ in own]


def test_decompose(spark, tokenizer):
    rng = random.Random(3)
    texts = ["", None, "one two", "one two", "x " * 9000, "word " * 1023, "word " * 1024, " \n"] + [" ".join(rng.choices(PARTS, k=rng.randint(0, 300))) for _ in range(150)] + ["copied text"] * 80
    docs = [*enumerate(texts), (None, "no id"), (2, "another two")]
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], SCHEMA).repartition(9)
    check(decomposition.decompose(df, PATH, batch_tokens=2048).collect(), docs, tokenizer, 1024, 2048)
    check(decomposition.decompose(df, PATH, 8, batch_tokens=16).collect(), docs, tokenizer, 8, 16)
    assert decomposition.decompose(df.limit(0), PATH).count() == 0
    kept = decomposition.decompose(df, PATH, keep_ids=True).filter("doc_id = 4").orderBy("start").collect()
    ids = np.frombuffer(b"".join(r.ids for r in kept), "<u4").tolist()
    assert ids == [*tokenizer.whole.encode(texts[4], add_special_tokens=False).ids, 0]
    with pytest.raises(ValueError):
        decomposition.decompose(df, PATH, 1000)


def test_query(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    check(op11_power_of_two(spark, folder).collect(), docs, tokenizer, 1024, decomposition.BATCH)


def test_words_around_line_feeds_are_learned_apart():
    tokenizer = ByteTokenizer(PATH)
    texts = [f"of {a}.\nThe {a}, {b}.\nThe {b}" for a in ("erst", "été", "12") for b in ("lyan", "über", "don't")] + ["of erst. \nThe lyan.", "of erst.\n\nThe lyan.", "of erst\xa0\nThe lyan.\n", " \nThe", "\nThe\n"]
    found = [np.frombuffer(ids, "<u4").tolist() for ids in tokenizer.ids([t.encode() for t in texts])]
    assert found == [tokenizer.whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(b"\n" not in chunk.strip(b"\n") for chunk in tokenizer.known if b"\n\n" not in chunk and b"\xa0" not in chunk)
    assert b"\nThe" in tokenizer.known
