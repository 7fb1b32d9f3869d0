"""Interaction audit of quality filters by inclusion-exclusion.

Every document gets flags, one per filter it fails. For each of the 32 sets of
filters one sum of flag products counts the documents that fail all of the set;
everything else follows from those counts. Their Möbius inverse says how many
survive any set of filters, hence what each step of each order of the filters
keeps, removes and finds removed already; filters fail alone as often as the
alternating sum over the sets around them says; and a set's dividend in the game
"documents removed" is its count with alternating sign, of which each member's
Shapley value takes an equal share.

Documents never meet: a repeat is known from counts and smallest ids of
(text digest, part, flags, labels), combined before each shuffle, so that a
text or a part with a third of all rows is as many rows as tasks that saw it.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, digest_long, narrow

LETTERS = "ABCDE"
#: Limits of the filters: words, percent of words that differ, percent of upper-case letters, symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_flags(text: Column) -> dict[str, Column]:
    """The filters that look at one text only, true where it fails."""
    words = F.array_remove(F.split(text, BLANKS), "")
    upper = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long"),
        "C": 100 * upper.cast("long") > MOST_UPPER * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def patterns(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts of documents by part, flags and labels: part, A, B, C, D (0 or 1), good, toxic, n, repeats (of those, E fails)."""
    rows = narrow(docs, doc_id=id_col, text=text_col, part=part_col)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flags = [failed.cast("int").alias(letter) for letter, failed in text_flags(F.col("text")).items()]
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *flags)
    keys = ["digest", "part", *LETTERS[:4]]
    rows = rows.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("times"))
    # Rows without an id have no label; they are spread instead of meeting in one task.
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), digest_long("digest", "part")).otherwise(F.lit(0)))
    marks = narrow(labels, id="doc_id", quality="quality", toxic="toxic").filter("id IS NOT NULL").groupBy(F.col("id").cast("long").alias("id"))
    marks = marks.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marks = marks.withColumn("zero", F.lit(0).cast("long"))
    rows = rows.join(marks, (F.col("doc_id") == F.col("id")) & (F.col("spread") == F.col("zero")), "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    identified = F.col("doc_id").isNotNull()
    groups = rows.groupBy(*keys, "good", "toxic").agg(
        F.sum("times").alias("n"),
        F.sum(F.when(identified, F.col("times")).otherwise(0)).alias("ids"),
        F.min(F.when(identified, F.struct("doc_id", "times"))).alias("first"),
    )
    # Rows of a digest: its parts, times four at most.
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("repeats", F.col("ids") - F.when(F.col("first.doc_id") == smallest, F.col("first.times")).otherwise(0))
    return groups.groupBy("part", *LETTERS[:4], "good", "toxic").agg(F.sum("n").alias("n"), F.sum("repeats").alias("repeats"))


def joint_failures(counts: DataFrame) -> DataFrame:
    """Per part, for every set of filters (bit i: the i-th letter), how many documents fail all of it: arrays n, good, toxic."""
    sums = []
    for measure, weight in (("n", F.lit(1)), ("good", F.col("good")), ("toxic", F.col("toxic"))):
        for s in range(1 << len(LETTERS)):
            flags = [F.col(letter) for i, letter in enumerate(LETTERS[:4]) if s >> i & 1]
            sums.append(F.sum(reduce(mul, flags, F.col("repeats" if s >> 4 else "n") * weight)).alias(f"{measure}{s}"))
    joint = counts.groupBy("part").agg(*sums)
    return joint.select("part", *[F.array(*[F.col(f"{m}{s}") for s in range(1 << len(LETTERS))]).alias(m) for m in ("n", "good", "toxic")])


def _signed(array: str, sets: list[tuple[int, int]]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(array)[s] * F.lit(weight) for s, weight in sets])


def interactions(joint: DataFrame) -> DataFrame:
    """From joint failures to a row for each part, order of the filters and step."""
    bits = len(LETTERS)
    odd = [s.bit_count() % 2 for s in range(1 << bits)]
    # Survivors of every set of filters: the Möbius inverse over its subsets.
    survivors = {m: F.array(*[_signed(m, [(s, -1 if odd[s] else 1) for s in range(1 << bits) if s & t == s]) for t in range(1 << bits)]) for m in ("n", "good", "toxic")}
    around = [[s for s in range(1 << bits) if s >> i & 1] for i in range(bits)]
    alone = F.array(*[_signed("n", [(s, 1 if odd[s] else -1) for s in own]) for own in around])
    orders = list(permutations(range(bits)))
    dividends = F.array(*[_signed("n", [(s, (1 if odd[s] else -1) * len(orders) // s.bit_count()) for s in own]) for own in around])
    steps = [(order, k) for order in orders for k in range(bits)]
    table = F.array(*[F.struct(F.lit("".join(LETTERS[i] for i in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(order[k]).alias("i"), F.lit(1 << order[k]).alias("own"), F.lit(sum(1 << i for i in order[:k])).alias("before")) for order, k in steps])
    parts = joint.select("part", F.col("n").alias("fails"), *[c.alias(f"left_{m}") for m, c in survivors.items()], alone.alias("alone"), dividends.alias("dividends"))
    rows = parts.select("*", F.explode(table).alias("s")).select("*", "s.*")
    now = F.col("before") + F.col("own")
    lost = {m: F.col(f"left_{m}")[F.col("before")] - F.col(f"left_{m}")[now] for m in survivors}
    return rows.select(
        "part", "filter_order", "step", F.col("left_n")[now].alias("kept"), lost["n"].alias("removed"),
        (F.col("fails")[F.col("own")] - lost["n"]).alias("redundant"), F.col("alone")[F.col("i")].alias("unique_fails"),
        lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), F.col("dividends")[F.col("i")].alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What five filters remove in each order, by part: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty, and fails A; a null part is the empty one. E fails
    where a smaller id of the table has the same text: rows that repeat the
    smallest id pass, a row without an id passes and makes no other fail. A
    document is good, or toxic, if any row of its id in ``labels`` says 1; rows
    without an id, and ids without a label, are neither. ``shapley`` is the
    filter's removals summed over all 120 orders. Texts of any length are read
    whole. An empty table has no parts and gives no rows; empty labels give
    zeros; other columns are ignored.
    """
    return interactions(joint_failures(patterns(docs, labels, id_col, text_col, part_col)))
