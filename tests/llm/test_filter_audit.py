import re
from collections import defaultdict
from itertools import permutations

from corvane.llm.filter_audit import filter_audit
from corvane.llm.queries import ORACLE_SQL, QUERIES

from ..duck import compare

DOCS, LABELS = "doc_id long, text string, source string, n int, A string, TEXT int", "doc_id long, quality int, toxic int, good string"


def brute(docs, labels):
    """The filters applied one after the other, for each part and order."""
    first, quality = {}, defaultdict(lambda: [0, 0])
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        if i is not None:
            quality[i][0] |= q == 1
            quality[i][1] |= x == 1
    parts = defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        good, toxic = quality[i] if i is not None else (0, 0)
        parts[source or ""].append(({k for k, v in fails.items() if v}, good, toxic))
    out, shapley = {}, defaultdict(int)
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for k, letter in enumerate(order):
                gone = [r for r in left if letter in r[0]]
                left = [r for r in left if letter not in r[0]]
                fails = sum(letter in r[0] for r in rows)
                out[part, "".join(order), k + 1] = [len(left), len(gone), fails - len(gone), sum(r[0] == {letter} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                shapley[part, letter] += len(gone)
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r["part"], r.filter_order, r.step): tuple(r[3:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit(spark):
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " ", long, long, long + "#", "a " * 300, "A " * 300, "ABC " + long, "few words & more", "é" * 5000, long.upper(), "x y " * 250, "\x0b".join(f"v{i}" for i in range(200))]
    docs = [(10 * i + k, t, s) for i, t in enumerate(texts) for k, s in enumerate(["web", None, "", "books"])]
    docs += [(1000 + i, long, "web") for i in range(300)] + [(30, long, "web"), (30, "few", "books"), (None, long, "web"), (None, long, "web"), (None, "other", None), (-5, "few", "web")]
    labels = [(10 * i, i % 2, i % 3 % 2) for i in range(14)] + [(30, 1, 0), (30, 0, 1), (None, 1, 1), (1005, 1, None), (1006, None, 1), (1007, 2, 3), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS).repartition(7)
    marks = spark.createDataFrame([(*x, "y") for x in labels], LABELS).repartition(3)
    assert found(filter_audit(frame, marks)) == brute(docs, labels)
    assert found(filter_audit(frame, marks.limit(0))) == brute(docs, [])
    assert filter_audit(frame.limit(0), marks).count() == 0


def test_query_equals_its_sql(spark):
    compare(spark, QUERIES["op13_filter_audit"], ORACLE_SQL["op13_filter_audit"], "/root/testdata/sf0.001")
