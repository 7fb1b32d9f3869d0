"""Audits of splits and of extracted corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lower_collapse, strip, text_hash, text_key, text_of

RISKY_RATIO, PURITY = 1.25, 0.95


def _hash(text: str, key: str | None) -> Column:
    """The hash of a text, or the column that has it already."""
    return F.col(key) if key else text_hash(text)


def split_counters(df: DataFrame, ident: str = "id", text: str = "text", split: str = "split", key: str | None = None) -> DataFrame:
    """rows, unique_ids and unique_text_hash of each split."""
    rows = df.select(split, F.col(ident).cast("string").alias("_i"), _hash(text, key).alias("_h"))
    return rows.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("_i").alias("unique_ids"), F.countDistinct("_h").alias("unique_text_hash"))


def _shared(df: DataFrame, split: str, value: str) -> DataFrame:
    """Pairs of splits (a < b) that have a value in common: (a, b, value), once for each; null is none."""
    sets = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.sort_array(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    a = sets.select(value, "s", F.explode("s").alias("a"))
    return a.select(value, "a", F.explode(F.filter("s", lambda x: x > F.col("a"))).alias("b"))


def split_overlap(df: DataFrame, ident: str = "id", text: str = "text", split: str = "split", samples: int = 10, key: str | None = None) -> DataFrame:
    """(a, b, id_overlap, text_hash_overlap, sample_ids) of the pairs of splits that share anything.

    The splits of a value are one small set, so a value never meets itself in a
    join.
    """
    rows = df.select(F.col(split).alias("_s"), F.col(ident).cast("string").alias("_i"), _hash(text, key).alias("_h"))
    ids = _shared(rows.select("_s", "_i").distinct(), "_s", "_i")
    by_id = ids.groupBy("a", "b").agg(F.count(F.lit(1)).alias("id_overlap"))
    first = _smallest(ids, samples)
    by_text = _shared(rows.select("_s", "_h").distinct(), "_s", "_h").groupBy("a", "b").agg(F.count(F.lit(1)).alias("text_hash_overlap"))
    joined = by_id.join(by_text, ["a", "b"], "full").join(first, ["a", "b"], "left")
    return joined.select("a", "b", F.coalesce("id_overlap", F.lit(0)).alias("id_overlap"), F.coalesce("text_hash_overlap", F.lit(0)).alias("text_hash_overlap"), F.coalesce("sample_ids", F.array().cast("array<string>")).alias("sample_ids"))


def _smallest(ids: DataFrame, n: int) -> DataFrame:
    """The n smallest ids of each pair: first of each of many buckets, then of the pair."""
    from pyspark.sql import Window

    rank = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_i"))
    some = ids.withColumn("_k", F.pmod(F.xxhash64("_i"), F.lit(1024)))
    some = some.withColumn("_r", rank(["a", "b", "_k"])).filter(F.col("_r") <= n)
    some = some.withColumn("_r", rank(["a", "b"])).filter(F.col("_r") <= n)
    return some.groupBy("a", "b").agg(F.sort_array(F.collect_list("_i")).alias("sample_ids"))


def split_alias(df: DataFrame, a: str = "job", b: str = "test", ident: str = "id", text: str = "text", split: str = "split", key: str | None = None) -> DataFrame:
    """One row: whether two splits have the same sets of ids and of texts."""
    rows = df.filter(F.col(split).isin(a, b)).select(F.col(split).alias("_s"), F.array(F.struct(F.lit("id").alias("k"), F.col(ident).cast("string").alias("v")), F.struct(F.lit("text").alias("k"), _hash(text, key).alias("v"))).alias("x"))
    sides = rows.select("_s", F.explode("x").alias("x")).filter("x.v IS NOT NULL").groupBy("x.k", "x.v").agg(F.countDistinct("_s").alias("n"))
    return sides.agg(F.coalesce(F.min("n") == 2, F.lit(False)).alias("is_alias"))


def contains_any(texts: Column, values: Column, least: int = 4) -> Column:
    """Whether the text, lower-case and collapsed, has a value of at least so many characters."""
    return F.coalesce(F.exists(values, lambda v: (F.length(v) >= least) & F.contains(texts, F.lower(v))), F.lit(False))


def document_flags(docs: DataFrame) -> DataFrame:
    """Flags of extracted documents: leaks of metadata into the text, risky segments, emptiness, missing ids.

    docs: xml_id, domains, crawls (arrays), class_codes (array of scheme and
    value), text_all, text_no_segments, has_text, has_segments.
    """
    codes = F.transform("class_codes", lambda c: c["value"])
    # The lowered text is a variable, so that it is made once and not for each value.
    found = F.transform(F.array(lower_collapse("text_all")), lambda t: F.struct(contains_any(t, F.col("domains")).alias("d"), contains_any(t, F.col("crawls")).alias("c"), contains_any(t, codes).alias("k")))
    n, m = F.length(text_of("text_all")), F.length(text_of("text_no_segments"))
    rows = docs.withColumn("missing_id", strip(text_of("xml_id")) == "")
    rows = rows.withColumn("_found", found[0])
    rows = rows.withColumns({"domain_in_text": F.col("_found.d"), "crawl_in_text": F.col("_found.c"), "classcode_in_text": F.col("_found.k")}).drop("_found")
    return rows.withColumn("len_all", n).withColumn("len_no_segments", m).withColumn("segments_risky", F.col("has_segments") & (m > 0) & (n > RISKY_RATIO * m)).withColumn("empty_text", (n == 0) & (m == 0))


def document_issues(docs: DataFrame) -> DataFrame:
    """The documents with issues: xml_id, issues, lengths and numbers of metadata."""
    rows = document_flags(docs)
    names = [("missing_id", "missing_xml_id"), ("domain_in_text",) * 2, ("crawl_in_text",) * 2, ("classcode_in_text",) * 2, ("segments_risky", "segments_dup_risky")]
    issues = F.concat_ws(";", *[F.when(F.col(c), name) for c, name in names], F.when(strip(text_of("text_all")) == "", "empty_text_all"))
    return rows.select("xml_id", issues.alias("issues"), "len_all", "len_no_segments", F.size("domains").alias("n_domains"), F.size("crawls").alias("n_crawls"), F.size("class_codes").alias("n_classcodes")).filter("issues <> ''")


#: Counters of documents by flags.
_COUNTERS = {
    "missing_xml_id": "missing_id", "missing_text_node": "empty_text AND NOT has_text", "empty_text_docs": "empty_text", "segments_present_docs": "has_segments", "segments_dup_risky_docs": "segments_risky",
    "leak_domain_in_text_docs": "domain_in_text", "leak_crawl_in_text_docs": "crawl_in_text", "leak_classcode_in_text_docs": "classcode_in_text",
}


def corpus_summary(docs: DataFrame) -> DataFrame:
    """One row of counters over extracted documents, repeated ids and texts and the purity of domains included.

    One pass: a document gives a row for its flags, its id, its text's hash and
    each of its domains, and all of them are counted by one aggregation, which
    is combined in every task before its shuffle.
    """
    rows = document_flags(docs)
    flags = F.concat(*[F.when(F.expr(f), "1").otherwise("0") for f in _COUNTERS.values()])
    own = strip(text_of("xml_id"))
    key = lambda kind, k, v=None: F.struct(F.lit(kind).alias("kind"), k.alias("key"), (F.lit(None).cast("string") if v is None else v).alias("value"))
    text = F.get(F.transform(F.filter(F.array(text_key("text_all")), lambda t: t != ""), F.sha1), F.lit(0))
    single = F.array(key("doc", flags), key("id", F.when(own != "", own)), key("text", text))
    label = _first_label()
    domains = F.when(label.isNotNull(), F.transform("domains", lambda d: key("domain", d, label))).otherwise(F.array().cast("array<struct<kind:string,key:string,value:string>>"))
    keys = rows.select(F.explode(F.concat(single, domains)).alias("k")).select("k.*").filter("key IS NOT NULL")
    counts = keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    of = lambda kind, n: F.when(F.col("kind") == kind, n)
    counters = [total(of("doc", F.when(F.substring("key", i, 1) == "1", F.col("n")))).alias(name) for i, name in enumerate(_COUNTERS, 1)]
    pure = (F.col("low") == F.col("high")).cast("long")
    out = counts.agg(
        total(of("doc", F.col("n"))).alias("n_docs"), *counters, total(of("id", F.col("n") - 1)).alias("duplicate_xml_id"), total(of("text", F.col("n") - 1)).alias("duplicate_text_exact_docs"),
        F.count(of("domain", F.lit(1))).alias("domains_total"), total(of("domain", pure)).alias("domains_pure"),
    )
    return out.withColumn("purity_ratio", F.when(F.col("domains_total") > 0, F.col("domains_pure") / F.col("domains_total")).otherwise(0.0))


PURITY_COLUMNS = ("domains_total", "domains_pure", "purity_ratio")


def corpus_counters(docs: DataFrame) -> DataFrame:
    """The counters of documents, ids and texts."""
    return corpus_summary(docs).drop(*PURITY_COLUMNS)


def _first_label() -> Column:
    """A document's first class code with a value."""
    return F.get(F.filter(F.transform("class_codes", lambda c: c["value"]), lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))


def domain_purity(docs: DataFrame) -> DataFrame:
    """One row: domains with any label, those with one label, and their ratio; a document's label is its first class code with a value."""
    pairs = docs.select(F.explode("domains").alias("d"), _first_label().alias("l")).filter("l IS NOT NULL")
    per = pairs.groupBy("d").agg(F.min("l").alias("low"), F.max("l").alias("high"))
    pure = F.col("low") == F.col("high")
    return per.agg(F.count(F.lit(1)).alias("domains_total"), F.count_if(pure).alias("domains_pure"), F.coalesce(F.avg(pure.cast("double")), F.lit(0.0)).alias("purity_ratio"))


def duplicate_pairs(docs: DataFrame, ident: str = "id", text: str = "text", pos: str = "pos", most: int = 20) -> DataFrame:
    """The first pairs (id, first_id) of a document and the earlier one with its text."""
    rows = docs.filter(text_key(text) != "").select(F.col(ident).alias("id"), F.col(pos).alias("p"), text_hash(text).alias("h"))
    firsts = rows.groupBy("h").agg(F.min(F.struct("p", "id")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(firsts, "h").filter(F.col("p") > F.col("f.p")).orderBy("p").limit(most).select("id", F.col("f.id").alias("first_id"))


def critical_flags(summary: dict) -> list[str]:
    """Names of what makes a corpus critical, by the row of ``corpus_summary``."""
    checks = [("duplicate_xml_id", summary["duplicate_xml_id"] > 0), ("duplicate_text_exact", summary["duplicate_text_exact_docs"] > 0), ("segments_dup_risky", summary["segments_dup_risky_docs"] > 0), ("domain_label_purity_high", summary["domains_total"] > 0 and summary["purity_ratio"] > PURITY)]
    return [name for name, hit in checks if hit]
