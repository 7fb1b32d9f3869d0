import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvane.llm import language_id as L
from corvane.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def symbols(text):
    out, before = [], False
    for c in text.lower():
        if c.isalpha():
            out.append(ord(c) % 4095 + 1)
        elif before:
            out.append(0)
        before = c.isalpha()
    return out


def plain_model(texts):
    """Interpolated Kneser-Ney by dictionaries."""
    counts = {5: Counter()}
    for t in texts:
        s = [0] * 4 + symbols(t)
        counts[5].update(tuple(s[i : i + 5]) for i in range(len(s) - 4))
    for n in (4, 3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    tables = {}
    for n, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = defaultdict(int), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        tables[n] = (c, total, kinds, d)

    def p(g):
        if not g:
            return 2.0**-12
        c, total, kinds, d = tables[len(g)]
        h = g[:-1]
        if not total.get(h):
            return p(g[1:])
        return max(c.get(g, 0) - d, 0) / total[h] + d * kinds[h] / total[h] * p(g[1:])

    return p


def test_models_equal_plain_kneser_ney():
    texts = {"a": ["Hello, wörld! hello again", "help hollow"], "b": ["zum Beispiel: ßtraße", "  zzz", "1234"]}
    counted = []
    for k in texts:
        code, _ = L.codes(texts[k])
        counted.append(np.unique(code, return_counts=True))
    models = L.fit_kneser_ney(list(texts), counted)
    tests = ["hello zum xyz", "é", "Wörld 12 beispiel!", "", "...", "helloİ"]
    entropy, n = models.entropies(tests)
    for j, k in enumerate(texts):
        p = plain_model(texts[k])
        for i, t in enumerate(tests):
            s = [0] * 4 + symbols(t)
            grams = [tuple(s[q : q + 5]) for q in range(len(s) - 4)]
            assert n[i] == len(grams)
            if grams:
                assert abs(entropy[i, j] + sum(math.log(p(g)) for g in grams) / len(grams)) < 1e-5
    found = models.predict(tests)
    assert found["lang"].tolist()[3:5] == ["und", "und"] and found["rejected"].tolist()[3:5] == [True, True]
    assert ((found["score"] >= 0) & (found["score"] <= 1)).all()


def test_held_out_accuracy(spark):
    rows = QUERIES["op8_language_id"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.99 * len(held)
    assert sum(r.rejected for r in rows) <= 2


def test_odd_rows(spark):
    base = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 30)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 34 !", "fr"), (None, "the dog", "en"), (103, "le chat " * 5000, None), (103, "le chat", None), (104, "the 😀 cat".encode("utf-16", "surrogatepass").decode("utf-16"), None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in base + odd], "doc_id long, text string, lang string, score int, LANG string")
    found = L.identify(df).collect()
    assert len(found) == len(base) + len(odd)
    by = {(r.doc_id, r.lang_pred) for r in found}
    assert {(100, "und"), (101, "und"), (102, "und"), (None, "en"), (103, "fr"), (104, "en")} <= by
    assert L.identify(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", df["score"].cast("string")).select("doc_id", "text").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(found) - 3


def test_gibberish_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(10**6, "qxzkvwj pqzxw kkvvqq xzzq wvkq " * 20, None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.rejected for r in L.identify(docs.unionByName(junk)).collect()}
    assert found[10**6]


@pytest.mark.parametrize("out", ["en", "fr"])
def test_a_language_left_out(spark, out):
    """Texts of a language that isn't learned are rejected; those in two languages that are, one after the other or by turns, are not."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    known = [[r.text for r in docs if r.lang == c and zlib.crc32(str(r.doc_id).encode()) % 5 == 0][:40] for c in ("de", "en", "es", "fr") if c != out]
    rows = [(r.doc_id, r.text, None if r.lang == out else r.lang) for r in docs]
    for i, (a, b) in enumerate((a, b) for k in range(3) for a, b in zip(known[k], known[(k + 1) % 3])):
        rows.append((10**6 + i, f"{a} {b}", None))
        turns = zip(*(re.split(r"(?<=[.!?])\s+", t) for t in (a, b)))
        rows.append((2 * 10**6 + i, " ".join(f"{x} {y}" for x, y in turns), None))
    rejected = {r.doc_id: r.rejected for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    foreign = [rejected[r.doc_id] for r in docs if r.lang == out]
    own = [rejected[r.doc_id] for r in docs if r.lang not in (None, out)]
    mixed = [x for i, x in rejected.items() if i >= 10**6]
    assert len(mixed) >= 40 and sum(foreign) >= 0.8 * len(foreign) and sum(own) <= 2 and sum(mixed) <= 0.02 * len(mixed)


def test_small_labels_are_learned(spark):
    """A label of one document, and one whose documents share id and text, are learned; no number of labels is an error."""
    docs = [(i, f"plain words of the usual tongue number {i} and more of them", "en") for i in range(1, 300)]
    rare = [(4000 + k, " ".join(f"{a}{b}{a}{b}x{a}" for a in chr(0x400 + 2 * k) for b in "abcdefgh"), f"r{k:04d}") for k in range(300)]
    same = [(7, "zzyq qyzz zqyz yzqz", "same")] * 150
    df = spark.createDataFrame(docs + rare + same, "doc_id long, text string, lang string")
    models = L.fit(df)
    assert models.labels == sorted({r[2] for r in docs + rare + same})
    assert models.predict([rare[0][1], same[0][1], docs[0][1]])["lang"].tolist() == ["r0000", "same", "en"]
