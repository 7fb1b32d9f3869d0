import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corvane.llm import pii

KEY = "it's a \\ key"


def feistel(symbols, bases, kind):
    s, n = list(symbols), len(symbols)
    h = n // 2
    for r in range(1, 11):
        other = s[h:] if r % 2 else s[:h]
        k = hashlib.sha512("|".join([KEY, kind, str(n), str(r), ",".join(map(str, other))]).encode()).hexdigest()
        s = [(x + int(k[4 * (i % 32) : 4 * (i % 32) + 4], 16)) % bases[i] if (r % 2 == 1) == (i < h) else x for i, x in enumerate(s)]
    return s


def string(v, a, b, kind):
    at = [i for i, c in enumerate(v) if a <= i < b and re.match("[0-9A-Za-z]", c)]
    low = lambda c: 48 if c.isdigit() else 97 if c.islower() else 65
    new = feistel([ord(v[i]) - low(v[i]) for i in at], [10 if v[i].isdigit() else 26 for i in at], kind)
    out = list(v)
    for i, x in zip(at, new):
        out[i] = chr(x + low(v[i]))
    return "".join(out)


def luhn(d):
    q = [int(c) for c in d][::-1]
    return sum(q[0::2] + [2 * x - (9 if x > 4 else 0) for x in q[1::2]]) % 10


def card(v):
    d = re.sub(r"\D", "", v)
    e = string(d[:-1], 0, len(d) - 1, "card")
    z = iter(e + str((10 - luhn(e + "0")) % 10))
    return "".join(next(z) if c.isdigit() else c for c in v)


def date(d):
    n = (d - datetime.date(1800, 1, 1)).days
    a, b = feistel([n // 773, n % 773], [189, 773], "date")
    return datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)


CASES = {
    "4539578763621486": card, "4539 5787 6362 1486": card, "4539-5787-6362-1486": card, "378282246310005": card,
    "John.b1@mail5.example.com": lambda v: string(v, 0, v.index("@"), "email"), "+1 (743) 555-3824": lambda v: string(v, 2, len(v), "phone"), "(743) 555-3824": lambda v: string(v, 0, len(v), "phone"),
    "152.143.123.131": lambda v: ".".join(map(str, feistel([152, 143, 123, 131], [256] * 4, "ip"))), "2020-02-29": lambda v: str(date(datetime.date(2020, 2, 29))),
    "31/12/1999": lambda v: date(datetime.date(1999, 12, 31)).strftime("%d/%m/%Y"), "12.31.1999": lambda v: date(datetime.date(1999, 12, 31)).strftime("%m.%d.%Y"),
}
LEFT = ["4539578763621487", "256.1.1.1", "01.2.3.4", "1.2.3.4.5", "2021-02-29", "2021-13-01", "1799-12-31", "000-45-6789", "666-12-1234", "x4539578763621486", "deadbeef4539578763621486", "12345", "a@b", "@", "3.14"]


def run(spark, texts):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, pii int")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == ["doc_id", "text", "pii", "pii"]
    return {r[0]: (r[1], r[3]) for r in out.collect()}


@pytest.mark.parametrize("value", list(CASES))
def test_values(spark, value):
    new = CASES[value](value)
    found = run(spark, [f"a {value}, {value}\n{value}", value])
    assert found[0][0] == f"a {new}, {new}\n{new}" and found[1][0] == new
    assert new != value and len(new) == len(value) or "." in value


def test_what_is_left_alone(spark):
    texts = [f"see {v} there" for v in LEFT] + [None, "", "plain text. " * 2000]
    found = run(spark, texts)
    assert [found[i][0] for i in range(len(texts))] == texts and all(not found[i][1] for i in range(len(texts)))


def test_ssn_and_counts(spark):
    found = run(spark, ["123-45-6789 and a@b.org 4539578763621486 4539578763621486"])[0]
    a, b, c = feistel([122, 44, 6788], [898, 99, 9999], "ssn")
    assert found[0].startswith(f"{a + (2 if a >= 665 else 1):03d}-{b + 1:02d}-{c + 1:04d} and ")
    assert found[1] == {"ssn": 1, "email": 1, "card": 2}


def test_address_in_a_text_without_digits(spark):
    value = "alice@example.org"
    new = string(value, 0, value.index("@"), "email")
    found = run(spark, [f"write to {value}", f"write to {value} in 7 days"])
    assert found[0] == (f"write to {new}", {"email": 1}) and found[1] == (f"write to {new} in 7 days", {"email": 1})


def test_permutation(spark):
    """Different values stay different: all IPv4 of a block, and every day of the range."""
    block = spark.range(5000).select(F.concat(F.lit("10.0."), (F.col("id") / 256).cast("int").cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("text"))
    assert pii.pseudonymise(block, KEY).select("text").distinct().count() == 5000
    days = spark.range(20_000).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pii.pseudonymise(days, KEY).select("text").distinct().count() == 20_000


LONG = [unit * (60_000 // len(unit)) for unit in ("a.", "a-.", "a", "1", "+", "+1 ", "1.", "1.2.3.4", "1234 ", "1234-", "123-45-", "(123) ", "12/", "2020-", "@", "a@", "a@b.", "%", "é@")]
LONG += ["a." * 500_000, "1234 " * 200_000]


def test_long_runs(spark):
    """Long runs, up to a megabyte, of what each pattern repeats neither ends the search early nor fills the stack; an address behind it is found."""
    before = ["", "x@", "1@a."]
    texts = [b + t for t in LONG for b in before]
    behind = run(spark, [f"{t} alice@example.org" for t in texts])
    assert all(text.endswith(" " + string("alice@example.org", 0, 5, "email")) and kinds["email"] >= 1 for text, kinds in behind.values())
    assert [len(text) for text, _ in behind.values()] == [len(t) + 18 for t in texts]
    assert run(spark, texts[:3]) == {i: (t, {}) for i, t in enumerate(texts[:3])}


def test_lengths_of_addresses(spark):
    ok = ["a" * 64 + "@b.org", "a@" + "b" * 63 + ".org", "a@" + "b." * 127 + "org", "a@b.org."]
    left = ["a" * 65 + "@b.org", "a@" + "b" * 64 + ".org"]
    assert all(kinds == {"email": 1} and text != t for t, (text, kinds) in zip(ok, run(spark, ok).values()))
    assert run(spark, left) == {i: (t, {}) for i, t in enumerate(left)}


def test_empty_repeated_and_clashing(spark):
    rows = [(1, "call +1 (743) 555-3824", "x", 1)] * 3 + [(2, "", "y", 2), (2, None, "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string, _found int")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == ["doc_id", "text", "pii", "_found", "pii"]
    found = [tuple(r) for r in out.collect()]
    assert len({str(r) for r in found[:3]}) == 1 and found[0][4] == {"phone": 1} and found[0][2:4] == ("x", 1)
    assert sorted(found[3:], key=repr) == sorted([(2, "", "y", 2, {}), (2, None, "y", 2, {})], key=repr)
    empty = pii.pseudonymise(df.limit(0), KEY)
    assert empty.columns == out.columns and empty.count() == 0


def test_key_is_not_in_the_plan(spark, capsys):
    df = spark.createDataFrame([(1, "mail a.person@example.org")], "doc_id long, text string")
    out = pii.pseudonymise(df, "a most private key")
    assert out.first().text != "mail a.person@example.org"
    out.explain("extended")
    plan = capsys.readouterr().out
    assert "Physical Plan" in plan and "private" not in plan
    assert "private" not in out._jdf.queryExecution().toString()
