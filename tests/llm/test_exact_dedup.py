import hashlib
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import exact_dedup as x
from corvane.llm.queries import ORACLE_SQL, QUERIES

from ..duck import compare


@given(st.lists(st.tuples(st.binary(max_size=6).map(lambda b: b.translate(bytes(97 + i % 2 for i in range(256)))), st.one_of(st.none(), st.integers(0, 50)), st.integers(1, 3)), max_size=80), st.sampled_from([1 << 30, 900, 1]))
@settings(max_examples=150, deadline=None)
def test_tries_merge_and_spill(items, budget):
    expected = {}
    for k, o, n in items:
        a, b = expected.get(k, (None, 0))
        expected[k] = (x._least(a, o), b + n)
    found = list(x.owners(items, budget))
    assert len(found) == len(expected) and {k: (o, n) for k, o, n in found} == expected


@given(st.text(alphabet=" \t\n\r\x0b\x0c\x1cab é", max_size=12))
def test_normalise(text):
    assert x.normalise(text.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", text)


def test_query_equals_its_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        compare(spark, QUERIES["op9_exact_dedup"], ORACLE_SQL["op9_exact_dedup"], f"/root/testdata/{sf}")


@pytest.mark.parametrize("budget", [1 << 20, 2000])
def test_groups(spark, monkeypatch, budget):
    monkeypatch.setattr(x, "LOCAL_BUDGET", budget)
    monkeypatch.setattr(x, "OWNER_BUDGET", budget)
    rng = random.Random(0)
    texts = ["hot  text", "hot text", None, "", " ", "\n\t", "a" * 100_000, "a" * 100_000, "case", "Case", "  x", "   x"]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(3, "twice"), (3, "twice"), (None, "twice"), (None, "lone")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, kept int, TEXT string").repartition(5)
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[key(t)].append(i)
    found = x.exact_dedup(df).collect()
    assert len(found) == len(rows)
    sha = {hashlib.sha256(k.encode()).hexdigest(): k for k in groups}
    kept = defaultdict(int)
    for r in found:
        ids = groups[sha[r.text_sha256]]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert all(kept[s] == 1 for s in sha)
    stays = x.keep_first(df)
    assert stays.columns == df.columns and sorted(key(r[1]) for r in stays.collect()) == sorted(groups)
    assert x.exact_dedup(df.limit(0)).count() == 0 and x.keep_first(df.limit(0)).count() == 0


def test_hot_rows_stay_where_they_are(spark):
    """A third of all rows with no id and no text: none of them is counted up and unfolded again in one task."""
    n = 300_000
    df = spark.range(0, n, 1, 12).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 1000)).alias("text"))
    out = x.exact_dedup(df)
    row = out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("kept"), F.max("group_size").alias("most")).first()
    assert (row.n, row.most) == (n, n // 3) and row.kept == out.select("text_sha256").distinct().count()
    parts = out.filter("doc_id IS NULL").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < n // 6
    assert x.keep_first(df).count() == row.kept
