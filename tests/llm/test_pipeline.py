import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import packing
from corvane.llm.common import claim, cut, runs
from corvane.llm.exact_dedup import normalise
from corvane.llm.language_id import identify
from corvane.llm.near_dedup import near_classes
from corvane.llm.queries import tokenizer_path
from corvane.llm.tokens import ChunkTokenizer

from .test_mixing import targets
from .test_near_dedup import brute

SF = "/root/testdata/sf0.001"
#: Columns that are called like those which operators add.
CLASHES = {"size": 1, "row": "r", "class_id": 2.5, "kept": None}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def check_language_id(before, rows):
    """At this size no label has rows enough to reject by: letterless texts go, and nothing else."""
    assert Counter(r[0] for r in rows) == Counter(r[0] for r in before if any(c.isalpha() for c in r.text or ""))


def check_exact_dedup(before, rows):
    first = {}
    for r in sorted(before, key=lambda r: r[0]):
        first.setdefault(normalise(r.text.encode()), r[0])
    assert sorted(r[0] for r in rows) == sorted(first.values())


def check_near_dedup(before, rows):
    classes = brute([(r[0], " ".join(r.text.split())) for r in before])
    assert sorted(r[0] for r in rows) == sorted(set(classes.values()))


def check_mixing(before, rows):
    sizes, largest, taken = defaultdict(int), Counter(), Counter()
    for r in before:
        sizes[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    for r in rows:
        taken[r.source] += words(r.text)
    for source, target in targets(sizes).items():
        assert 0 <= target - taken[source] <= largest[source] + 1
    assert max(Counter(r[0] for r in rows).values()) <= 2


def check_packing(before, rows):
    tokenizer, expected = ChunkTokenizer(tokenizer_path()), Counter()
    for r in before:
        ids = np.array([*tokenizer.whole.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        expected.update((r[0], k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    assert Counter(tuple(r)[:5] for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= len(packing.best_fit(np.array([r.length for r in rows]), 4096)[2]) + 1


CHECKS = {"language_id": check_language_id, "exact_dedup": check_exact_dedup, "near_dedup": check_near_dedup, "mixing": check_mixing, "packing": check_packing}


@pytest.fixture(scope="module")
def odd_documents(spark):
    """The documents, and null, empty, letterless, very long and repeated ones, with columns of clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.first().text
    long = " ".join(f"word{i * i % 7919} und the" for i in range(40_000))
    rows = [(9001, None, "en", "src1", None), (9002, "12 !", None, None, 4), (9003, text, "en", None, 1), (9004, "", "en", "src2", 0), (9005, long, "de", "src3", len(long)), (9006, "seen twice, in rows that are equal", "en", "src4", 34)]
    odd = spark.createDataFrame([*rows, rows[-1]], docs.schema)
    return cut(docs.unionByName(odd).withColumns({k: F.lit(v).cast("string") for k, v in CLASHES.items()}), "docs")


def test_stages_against_plain_versions(spark, odd_documents):
    docs, seen = odd_documents, []
    names = docs.columns
    every = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        out = cut(out, name)
        rows = out.collect()
        CHECKS[name](before, rows)
        if name != "packing":
            assert out.columns == names and {tuple(r) for r in rows} <= every
        docs = out
        seen.append(name)
    assert seen == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_foreign_texts_are_rejected(spark):
    """With rows enough to calibrate by, the stage keeps what op8 doesn't reject: other languages and scripts go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = ["Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει στο δάσος. " * 6, "Съешь ещё этих мягких французских булок, да выпей чаю. " * 8, "Zażółć gęślą jaźń, chrząszcz brzmi w trzcinie w Szczebrzeszynie. " * 8]
    docs = cut(docs.unionByName(spark.createDataFrame([(90_000 + i, t, None, "src1", len(t)) for i, t in enumerate(foreign)], docs.schema)), "docs")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").select("doc_id").collect()}
    assert kept == {r.doc_id for r in identify(docs).filter("NOT rejected").select("doc_id").collect()}
    assert not kept & {90_000, 90_001, 90_002} and len(kept) > 0.95 * docs.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100 and corpus_pipeline.ORACLE_SQL is None
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
    assert near_classes(spark.read.parquet(f"{SF}/documents.parquet")).count() == 200


def test_runs_and_claims():
    assert list(runs([3, 3, 9, 1, 1, 1], 6, 2)) == [slice(0, 2), slice(2, 3), slice(3, 5), slice(5, 6)] and not list(runs([], 5, 5))
    gone = []
    claim("a", lambda: gone.append("a"))
    claim("a", lambda: gone.append("a"))
    assert not gone
    claim("b")
    assert gone == ["a"]


def test_stages_hold_arrow_batches_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
        assert corpus_pipeline.packing(spark, docs, "").count() == 2
        assert spark.conf.get(key).rstrip("b") == str(2 << 20)
        spark.conf.set(key, "123456")  # a session's own setting stays
        corpus_pipeline.exact_dedup(spark, docs, "")
        assert spark.conf.get(key).rstrip("b") == "123456"
    finally:
        spark.conf.set(key, before)
