import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.text import hash_order, text_hash
from corvane.operators import balance, components, dedup, filters, metrics, models, ranks, sets, splits, stats
from corvane.plans import catalog


def test_hash_ranks_equal_a_window(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab") if i % 9 else None, rng.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, v int").withColumn("h", F.md5(F.concat(F.lit("z"), (F.col("id") % 300).cast("string"))))
    out = ranks.hash_ranks(df, ["k"], "h", ["id"], "r", "n", {"before": "v"}).collect()
    for key in ("a", "b", None):
        own = sorted((r for r in out if r.k == key), key=lambda r: (r.h, r.id))
        assert [r.r for r in own] == list(range(1, len(own) + 1)) and {r.n for r in own} == {len(own)}
        total = 0
        for r in own:
            assert r.before == total
            total += r.v


def test_leaks_equal_the_greedy_walk(spark):
    rng = random.Random(2)
    texts = ["a b", "A  b!", "c", "", None, "d e f"]
    rows = [(i, str(i), rng.choice(texts), rng.choice(["train", "dev", "test"])) for i in range(60)]
    df = spark.createDataFrame(rows, "pos int, id string, text string, split string")
    found = {r.id for r in dedup.remove_leaks(df).collect()}
    seen, expected = set(), set()
    key = lambda t: {"A  b!": "a b"}.get(t, t or "")
    for _, ident, text, _ in sorted(rows, key=lambda r: (["train", "dev", "test"].index(r[3]), r[0])):
        if key(text) not in seen:
            seen.add(key(text))
            expected.add(ident)
    assert found == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leaks_where_ids_repeat(spark, seed):
    """A row that leaks by its text leaves its id to later ones; null and blank ids are never equal."""
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, " ", *"abcdefghij"]), rng.choice("uvwxyzst") + rng.choice(["", "!", " q"]), rng.choice(["train", "dev", "test"])) for i in range(80)]
    df = spark.createDataFrame(rows, "pos int, id string, text string, split string").repartition(3)
    found = {r.pos for r in dedup.remove_leaks(df).collect()}
    ids, texts, expected = set(), set(), set()
    for pos, ident, text, _ in sorted(rows, key=lambda r: (["train", "dev", "test"].index(r[3]), r[0])):
        own, same = (ident or "").strip(), text.replace("!", "").strip()
        if own in ids or same in texts:
            continue
        ids |= {own} - {""}
        texts.add(same)
        expected.add(pos)
    assert found == expected


def _greedy(rows):
    ids, texts, kept = set(), set(), set()
    for order, ident, text in sorted(rows):
        if text not in texts and (ident is None or ident not in ids):
            kept.add(order)
            texts.add(text)
            ids.add(ident)
    return kept


WALK = "_order struct<s:int,p:bigint>, _id string, _hash string"


@pytest.mark.parametrize("most,seed", [(1, 1), (4, 2), (25, 3), (1000, 4)])
def test_walk_by_components(spark, most, seed):
    """However few rows a task takes, the walk is the sequential one: chains, a hot text, repeated rows, missing ids."""
    rng = random.Random(seed)
    chain = [((0, i), f"c{i // 2}", f"t{(i + 1) // 2}") for i in range(40)]
    some = [((rng.randint(0, 3), 100 + i), rng.choice([None, *(f"i{k}" for k in range(30))]), f"h{rng.randint(0, 30)}") for i in range(120)]
    hot = [((1, 500 + i), f"x{i % 20}", "hot") for i in range(60)] + [((2, 600 + i), "x1", "hot") for i in range(20)]
    rows = [*chain, *some, *hot]
    found = dedup.walked(spark.createDataFrame(rows, WALK).repartition(3), most).collect()
    assert {(r["_stays"].s, r["_stays"].p) for r in found} == _greedy(rows) and len(found) == len(_greedy(rows))


def test_leak_walk_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.concat_ws("-", "source", "n_chars").alias("own"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("label"), text_hash("text").alias("h"))
    rows = [((dedup.SPLITS.index(r.split), r.doc_id), r.own, r.h) for r in splits.three_way(docs).collect()]
    found = {(dedup.SPLITS.index(r.split), r.doc_id) for r in catalog.leak_walk(spark, folder).collect()}
    assert found == _greedy(rows) and len(found) < len(rows)


def test_long_chain(spark):
    """A chain of 100,000 rows that decide each other, one after the other."""
    n = 100_000
    chain = spark.range(n).select(F.struct(F.lit(0).alias("s"), F.col("id").alias("p")).alias("_order"), F.concat(F.lit("i"), F.expr("id div 2").cast("string")).alias("_id"), F.concat(F.lit("t"), F.expr("(id + 1) div 2").cast("string")).alias("_hash"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    found = sorted(r["_stays"].p for r in dedup.walked(chain).collect())
    assert len(tracker.getJobIdsForGroup(None)) - before < 30
    assert found == list(range(0, n, 2))


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (300, 300), (150, 100)] + [(1000, i) for i in range(1001, 1030)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert found == {i: 0 for i in range(1, 51)} | {150: 100, 200: 100} | {i: 1000 for i in range(1001, 1030)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 60, 200])
def test_shuffled_head(spark, n):
    df = spark.range(100).select((F.col("id") % 50).cast("string").alias("id"), F.col("id").alias("v")).repartition(4)
    found = dedup.shuffled_head(df, n).collect()
    assert len(found) == (min(n, 100) or 100)
    order = {str(i): spark.range(1).select(hash_order(42, "shuffle", F.lit(str(i)))).first()[0] for i in range(50)} if 0 < n < 100 else {}
    if order:
        first = sorted([i for i in order for _ in range(2)], key=lambda i: (order[i], i))[:n]
        assert sorted(r.id for r in found) == sorted(first)


def test_limits_are_exact(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1), float(rng.randint(0, 3)), 5.0, None) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    found = {r.column: (r.low, r.high) for r in stats.robust_limits(df, "a", "b", "c", "d").collect()}
    for i, c in enumerate("abc"):
        v = sorted(r[i] for r in rows)
        for p, got in zip((0.01, 0.99), found[c]):
            k = int(p * (len(v) - 1))
            assert abs(got - (v[k] + (v[k + 1] - v[k]) * (p * (len(v) - 1) - k))) < 1e-9
    assert found["d"] == (None, None)
    few = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "a double")
    assert [(round(r.low, 6), round(r.high, 6)) for r in stats.robust_limits(few, "a").collect()] == [(1.02, 3.96)]
    assert [tuple(r) for r in stats.robust_limits(few.limit(0), "a").collect()] == [("a", None, None)]


def test_seed_of_a_kernel_is_kept(spark, tmp_path):
    words = {"a": "red green blue", "b": "one two three"}
    rows = [(str(i), " ".join(random.Random(i).choices(words["ab"[i % 2]].split(), k=8)), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, text string, label string")
    model = models.train(df, models.Settings("m", "SVC", {"max_iter": 10}, (1, 2), 500, 2), seed=7)
    found = models.predict(model, df)
    assert model.seed == 7 and found.filter("label = prediction").count() == 60
    model.save(f"file://{tmp_path}/m")
    again = models.load(f"file://{tmp_path}/m", model.settings, model.gamma, model.seed)
    assert models.predict(again, df).exceptAll(found).count() == 0


def test_projection(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, Vectors.sparse(6, {i % 6: 3.0 + i % 2, (i + 1) % 6: 1.0}) if i % 3 else Vectors.dense([float(i % 4), 0, 2, 0, 1, 0])) for i in range(40)]
    out = {r.id: (r.x, r.y) for r in models.project_2d(spark.createDataFrame(rows, ["id", "features"])).collect()}
    m = np.array([v.toArray() for _, v in rows])
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(np.abs([out[i] for i in range(40)]), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_splits_and_empty(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).cast("string").alias("label"))
    assert Counter(r.split for r in splits.three_way(df, 0.5, 0.0, 0.0).collect()).keys() == {"train", "test"}
    assert splits.three_way(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        filters.require_rows(df.limit(0))


def test_long_texts(spark):
    df = spark.createDataFrame([("abcdef",), ("a",), (None,)], "text string")
    assert [r.text for r in filters.long_texts(df, 3, "truncate").collect()] == ["abc", "a", ""]
    assert filters.long_texts(df, 3, "drop").count() == 2 and filters.long_texts(df, 3, "keep").count() == 3
    with pytest.raises(Exception, match="more than 3"):
        filters.long_texts(df, 3, "raise").collect()
    with pytest.raises(ValueError):
        filters.long_texts(df, 3, "shorten")


def test_balance_dispatch(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 25, "a").otherwise("b").alias("label"), F.lit(2).alias("tokens"))
    count = lambda d: Counter(r.label for r in d.collect())
    assert count(balance.balance(df, "cap_docs", {"cap": 10, "oversample": True})) == {"a": 10, "b": 10}
    assert count(balance.balance(df, "alpha_total", {"alpha": 0.0, "total_docs": 40})) == {"a": 20, "b": 20}
    assert count(balance.balance(df, "cap_tokens", {"cap_tokens": 12})) == {"a": 6, "b": 6}
    assert count(balance.balance(df, "cap_tokens", {"cap_tokens": 1000})) == {"a": 50, "b": 10}
    assert balance.balance(df, "cap_docs", {}) is df and balance.balance(df, "none") is df
    ids = [r.id for r in balance.cap_docs(df, 10, True).filter("label = 'b'").collect()]
    assert len(set(ids)) == len(ids)


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("a", "a", None), ("a", "c", "x"), ("b", "a", "x")], "label string, prediction string, g string")
    one = metrics.summary(df).first()
    assert (one.n, round(one.accuracy, 6), round(one.macro_f1, 6)) == (3, 0.333333, 0.166667)
    groups = {(r.field, r.value): r.n for r in metrics.grouped(df, ["g", "nothing"]).collect()}
    assert groups == {("g", "__missing__"): 1, ("g", "x"): 2, ("nothing", "__missing__"): 3}
    zero = spark.createDataFrame([("x", 0.0)], "value string, weight double")
    assert {r.weight for r in metrics.normalised_weights(metrics.grouped(df, ["g"]), zero).collect()} == {0.5}
    cats = spark.createDataFrame([({"a": 0.1, "b": 0.9},), ({},)], "cats map<string, double>")
    assert [r[0] for r in cats.select(models.argmax_label("cats")).collect()] == ["b", models.NO_PREDICTION]


def test_sets_and_stats(spark):
    a = spark.createDataFrame([("1", "x"), ("b__2", "y")], "id string, label string")
    u = sets.corpus_union({"a": a, "b": a})
    assert sorted(r.id for r in u.collect()) == ["a__1", "a__b__2", "b__1", "b__2"]
    assert sets.same_set(a, a, "id").first()[0] and not sets.same_set(a, a.limit(1), "id").first()[0]
    assert stats.length_histogram(spark.createDataFrame([("c", "one")], "corpus_id string, text string")).first().bin == 0


@pytest.mark.parametrize("kind,params", [("LinearSVC", {"class_weight": "balanced"}), ("SVC", {}), ("Perceptron", {"max_iter": 30, "class_weight": "balanced"}), ("DecisionTreeClassifier", {"max_depth": 4}), ("RandomForestClassifier", {"n_estimators": 5, "max_depth": 4})])
def test_models_learn_and_reload(spark, tmp_path, kind, params):
    words = {"a": "red green blue", "b": "one two three", "c": "cat dog cow"}
    rows = [(str(i), " ".join(random.Random(i).choices(words["abc"[i % 3]].split(), k=8)), "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, text string, label string")
    model = models.train(df, models.Settings("m", kind, params, (1, 2), 500, 2))
    found = models.predict(model, df)
    assert found.filter("label = prediction").count() >= 85
    model.save(f"file://{tmp_path}/m")
    again = models.load(f"file://{tmp_path}/m", model.settings, model.gamma)
    assert models.predict(again, df).exceptAll(found).count() == 0


def test_unknown_model():
    with pytest.raises(ValueError, match="isn't configured"):
        models.settings_of("x", {"sklearn": {}})
    s = models.settings_of("m", {"sklearn": {"m": {"estimator": {"class": "p.LinearSVC", "params": {"C": 2}}, "vectorizer": {"params": {"ngram_range": "[1, 2]", "min_df": 3}}}}})
    assert (s.kind, s.ngrams, s.min_df) == ("LinearSVC", (1, 2), 3)
