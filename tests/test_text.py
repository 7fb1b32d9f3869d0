import time

import pytest

from corvane.functions import text as T

#: Texts with what each mode makes of them, written out.
EXPECTED = [
    # text, basic, aggressive, debias, any other mode
    ("", "", "", "", ""),
    (" \t ", "", "", "", ""),
    ("Noël  à Łódź\n", "noël à łódź", "noel a łodz", "noel a łodz", "Noël à Łódź"),
    ("E\u0301TÉ", "été", "ete", "ete", "ÉTÉ"),
    ("\ufb01le ＡＢ １２ ½", "file ab 12 1\u20442", "file ab 12 1\u20442", "file ab 12 1\u20442", "file AB 12 1\u20442"),
    ("no\u00a0break\u2003em\x1cfs\x85nel", "no break em fs nel", "no break em fs nel", "no break em fs nel", "no break em fs nel"),
    ("Look: HTTP://A.org/Ü?x#y now", "look: http://a.org/ü?x#y now", "look: http://a.org/u?x#y now", "look: now", "Look: HTTP://A.org/Ü?x#y now"),
    ("at www.b.fr, or https://c.de.", "at www.b.fr, or https://c.de.", "at www.b.fr, or https://c.de.", "at or", "at www.b.fr, or https://c.de."),
    ("(mail: foo@bar.com)!", "(mail: foo@bar.com)!", "(mail: foo@bar.com)!", "(mail: )!", "(mail: foo@bar.com)!"),
    ("<<a.b@c@d.e>>, x", "<<a.b@c@d.e>>, x", "<<a.b@c@d.e>>, x", "<< >>, x", "<<a.b@c@d.e>>, x"),
    ("@handle and a@ and @@ stay", "@handle and a@ and @@ stay", "@handle and a@ and @@ stay", "@handle and a@ and @@ stay", "@handle and a@ and @@ stay"),
    ("one,two@three two@,", "one,two@three two@,", "one,two@three two@,", "two@,", "one,two@three two@,"),
]


@pytest.mark.parametrize("mode,column", [("basic", 1), ("standard", 1), ("aggressive", 2), (" Full ", 2), ("debias", 3), ("something else", 4)])
def test_normalise(spark, mode, column):
    df = spark.createDataFrame([(i, e[0]) for i, e in enumerate(EXPECTED)] + [(99, None)], "i int, text string")
    found = {r.i: r.t for r in df.select("i", T.normalise("text", mode).alias("t")).collect()}
    assert found == {i: e[column] for i, e in enumerate(EXPECTED)} | {99: ""}


def test_normalise_nothing(spark):
    df = spark.createDataFrame([(i, e[0]) for i, e in enumerate(EXPECTED)] + [(99, None)], "i int, text string")
    for mode in ("none", "OFF", "0", None):
        assert {r.i: r.t for r in df.select("i", T.normalise("text", mode).alias("t")).collect()} == {i: e[0] for i, e in enumerate(EXPECTED)} | {99: ""}


def test_addresses_in_long_texts(spark):
    """Runs without blanks of a million characters take time in proportion."""
    runs = ["a-" * 500_000, "a@" * 500_000, "@-" * 500_000, "a" + "@" * 1_000_000, "." * 1_000_000 + "@"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(runs)], "i int, text string")
    start = time.monotonic()
    found = {r.i: r.t for r in df.select("i", T.strip_urls_emails("text").alias("t")).collect()}
    assert time.monotonic() - start < 60
    assert found == {0: runs[0], 1: "@", 2: runs[2], 3: runs[3], 4: runs[4]}


KEYS = [
    # text, key, tokens, tokens between spaces and newlines, words and marks
    ("", "", 0, 0, 0),
    ("Un, deux -- TROIS!", "un deux trois", 4, 4, 7),
    ("l'été_1  d\u2019Anna\t(b)", "l été_1 d anna b", 3, 2, 9),
    ("\x1c a\x85b c ", "a b c", 3, 3, 3),
    ("...", "", 1, 1, 3),
    ("x\ny  z", "x y z", 3, 3, 3),
]


def test_keys_and_counts(spark):
    df = spark.createDataFrame([(i, k[0]) for i, k in enumerate(KEYS)], "i int, text string")
    rows = df.select("i", T.text_key("text").alias("k"), T.token_count("text").alias("n"), T.token_count("text", "simple").alias("s"), T.token_count("text", "word_punct").alias("w")).collect()
    assert {r.i: (r.k, r.n, r.s, r.w) for r in rows} == {i: k[1:] for i, k in enumerate(KEYS)}


def test_redact(spark):
    rows = [("Go to WWW.Site.fr or site.fr, crawl_x here", "www.site.fr", "crawl_x"), ("abc abc", "abc", None), (r"a\Eb.c (A\EB.C)", r"a\Eb.c", None), (None, "www.x.org", "y")]
    df = spark.createDataFrame(rows, "text string, domain string, crawl string")
    found = [r[0] for r in df.select(T.redact_values("text", "domain", "crawl")).collect()]
    assert found == ["Go to or , here", "abc abc", "( )", ""]


def test_labels(spark):
    df = spark.createDataFrame([(" Far  Left/Right\\x ",), ("crawl-af-2025_01",), ("___",), ("É à",)], "v string")
    assert [r[0] for r in df.select(T.label_key("v")).collect()] == ["far_left_right_x", "crawl_af_2025_01", "", ""]
