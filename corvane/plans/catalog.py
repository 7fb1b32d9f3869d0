"""Every query of the core library: a plan over the tables, and its SQL where SQL can say it."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, balance, dedup, features, filters, labels, metrics, models, sets, splits, stats
from ..shared import checkpointed
from ..shipping import ship
from ..sources import dims, reports, tei
from . import oracles as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in the columns of prepared documents: the source is the label, the language the modality."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), "doc_id", "text", F.col("source").alias("label"), F.col("source").alias("label_raw"), F.col("lang").alias("modality"), F.col("lang").alias("corpus_id"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their language as label and a deterministic guess as prediction."""
    d = read(spark, sf_dir, "documents")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("p"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") % 7
    guess = F.when(draw == 0, "en").when(draw == 1, "fr").when(draw == 2, "xx").otherwise(F.col("lang"))
    return d.select("doc_id", F.col("lang").alias("label"), guess.alias("prediction"), F.col("source").alias("corpus_id"), F.when(F.col("doc_id") % 3 == 0, "web").otherwise("asr").alias("modality"))


def six(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


# --- the flagship


@query(O.PREPARE_VIEW)
def prepare_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = filters.min_chars(documents(spark, sf_dir), 200)
    # Only ids, counts and hashes move; texts end in the scan.
    keyed = docs.select("id", "doc_id", "pos", "label", T.token_count("text").alias("tokens"), T.text_hash("text").alias("text_hash"))
    kept = dedup.dedup(keyed, "text", key="text_hash")
    view = dedup.remove_leaks(splits.three_way(kept), key="text_hash")
    return view.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.sum("tokens").alias("tokens"))


# --- text functions


@query(O.NORMALIZE_LABEL)
def normalize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.label_key("url").alias("label"))


@query(O.TOKEN_COUNTS)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.token_count("text").alias("tokens"))


@query(O.TOKEN_COUNTS_SIMPLE)
def token_counts_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.token_count("text", "simple").alias("tokens"))


@query(O.TOKEN_COUNTS_WORD_PUNCT)
def token_counts_word_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.token_count("text", "word_punct").alias("tokens"))


def _spacy_sql() -> str | None:
    return None if importlib.util.find_spec("spacy") else O.TOKEN_COUNTS_SPACY


@query(_spacy_sql())
def token_counts_spacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.token_count("text", "spacy:fr").alias("tokens"))


@query(O.DEDUP_KEY_HASH)
def dedup_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.text_hash("text").alias("text_hash"))


@query(O.STATS_TEXT_MD5)
def stats_text_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.stats_key("text").alias("text_md5"))


@query(O.AUDIT_NORM_TEXT)
def audit_norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(T.lower_collapse("text")).alias("norm_md5"))


@query(O.REDACT_META)
def redact_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    pages = read(spark, sf_dir, "pages").select("page_id", "html", host.alias("domain"))
    return pages.select("page_id", F.md5(T.redact_values("html", "domain")).alias("redacted_md5"))


@query(O.STRIP_URLS_EMAILS)
def strip_urls_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(T.strip_urls_emails("text")).alias("stripped_md5"))


@query(O.NORMALIZE_AGGRESSIVE)
def normalize_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.normalise("text", "aggressive").alias("text"))


@query(O.NORMALIZE_DEBIAS)
def normalize_debias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.normalise("text", "debias").alias("text"))


@query(O.NORMALIZE_BASIC)
def normalize_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.normalise("text", "basic").alias("text"))


@query(O.SHORT_LABELS)
def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.short_label(F.concat(F.lit("crawl_"), F.col("label"), F.lit("_full_initiative_communiste_20250928_001323"))).alias("short"))


@query(O.TRUNCATE_LONG)
def truncate_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.long_texts(documents(spark, sf_dir), 1000, "truncate")
    return rows.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


# --- filters


@query(O.FILTER_MIN_CHARS_MAX_TOKENS)
def filter_min_chars_max_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.max_tokens(filters.min_chars(documents(spark, sf_dir), 400), 512).select("doc_id", "tokens")


@query(O.FILTER_MODALITY)
def filter_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_modality(documents(spark, sf_dir), "fr").select("doc_id", "label")


@query(O.LONG_TEXT_DROP)
def long_text_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.long_texts(documents(spark, sf_dir), 5000, "drop").select("doc_id")


# --- labels

_SIDES = [(f"src{i}", "left" if i % 3 else "right") for i in range(12)]
_ACTORS = {
    f"actor{i}": {"crawls": [f"src{i}", f"SRC {i + 10}"], "domains": ["en"] if i == 3 else ["fr "] if i == 4 else [], "side_binary": ("left", "right", None)[i % 3], "global_five": f"g{i % 5}", "intra_left": f"l{i}" if i % 2 == 0 else None, "intra_right": f"r{i}"}
    for i in range(8)
}


def _mapped(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    mapping = dims.mapping_table(spark, [(k.upper(), v) for k, v in _SIDES])
    return labels.map_label(documents(spark, sf_dir), mapping, policy).select("doc_id", "label")


@query(O.LABEL_MAP["drop"])
def label_map_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, "drop")


@query(O.LABEL_MAP["keep"])
def label_map_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, "keep")


@query(O.LABEL_MAP["other"])
def label_map_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, "other")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    bridge, attributes = dims.actor_tables(spark, _ACTORS)
    docs = documents(spark, sf_dir).withColumn("crawl", F.col("label")).withColumn("domain", F.when(F.col("doc_id") % 5 == 0, F.col("modality")))
    return labels.resolve_actor(docs, bridge, attributes)


@query(O.ACTOR_RESOLUTION)
def actor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("doc_id", "actor_id", "side_binary")


@query(O.IDEOLOGY_VIEWS)
def ideology_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _resolved(spark, sf_dir)
    parts = [labels.ideology_label(rows, v).select("doc_id", F.lit(v).alias("view"), "label", "reason") for v in (*labels.VIEWS, "seven_way")]
    return sets.corpus_union({str(i): p for i, p in enumerate(parts)}, namespace=False).drop("corpus_id")


@query(O.IDEOLOGY_REASONS)
def ideology_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.reason_counts(labels.ideology_label(_resolved(spark, sf_dir), "left_intra", "keep"))


@query(O.ACTOR_MIN_DOCS)
def actor_min_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _resolved(spark, sf_dir).withColumn("actor", F.col("actor_id"))
    kept = filters.by_actor(rows, [f"actor{i}" for i in range(6)], 20)
    return stats.actor_counts(kept)


@query(O.ACTOR_COUNTS)
def actor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.actor_counts(_resolved(spark, sf_dir), "actor_id")


# --- dedup, limits, samples


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and, at later positions, those divisible by 4 once more."""
    docs = documents(spark, sf_dir)
    again = docs.filter(F.col("doc_id") % 4 == 0).withColumn("pos", F.col("pos") + 1_000_000_000)
    return docs.unionByName(again)


@query(O.DEDUP["id"])
def dedup_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(_twice(spark, sf_dir), "id").select("pos", "id")


@query(O.DEDUP["text"])
def dedup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(_twice(spark, sf_dir), "text").select("pos", "id")


@query(O.DEDUP["id_and_text"])
def dedup_id_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(_twice(spark, sf_dir), "id_and_text").select("pos", "id")


@query(O.LIMIT_HEAD)
def limit_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.limit(documents(spark, sf_dir).select("pos", "id", "doc_id", "label"), 100).select("doc_id", "label")


@query(O.LIMIT_RANDOM)
def limit_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.limit(documents(spark, sf_dir).select("pos", "id", "doc_id", "label"), 100, "random").select("doc_id", "label")


@query(O.SHUFFLED_HEAD)
def shuffled_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.shuffled_head(documents(spark, sf_dir).select("id", "doc_id"), 50).select("doc_id")


@query(O.DEBUG_SUBSAMPLE)
def debug_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.subsample(documents(spark, sf_dir).select("pos", "id", "doc_id"), 150).select("doc_id")


@query(O.SAMPLE_WHERE)
def sample_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.sample_where(documents(spark, sf_dir).select("id", "doc_id", "modality"), F.col("modality") == "en", 60).select("doc_id", "modality")


# --- splits and balancing


@query(O.STRATIFIED_SPLIT)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.two_way(documents(spark, sf_dir).select("id", "doc_id", "label"), 0.8).select("doc_id", "split")


@query(O.THREE_WAY_SPLIT)
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.three_way(documents(spark, sf_dir).select("id", "doc_id", "label"), 0.7, 0.2, 0.1).select("doc_id", "split")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.three_way(documents(spark, sf_dir).select("pos", "id", "doc_id", "label", T.text_hash("text").alias("text_hash")))


@query(O.LEAK_REMOVAL)
def leak_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.remove_leaks(_split(spark, sf_dir), key="text_hash").select("doc_id", "split")


@query()
def leak_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leak removal where ids repeat: source and length of a document stand for its id."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("pos"), F.concat_ws("-", "source", "n_chars").alias("id"), F.col("source").alias("label"), T.text_hash("text").alias("text_hash"))
    parts = splits.three_way(docs.withColumn("own", F.col("id")).withColumn("id", F.col("doc_id").cast("string")))
    return dedup.remove_leaks(parts.withColumn("id", F.col("own")).drop("own"), key="text_hash").select("doc_id", "split")


@query(O.LEAK_REMOVED_COUNTS)
def leak_removed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts(dedup.leak_marks(_split(spark, sf_dir), key="text_hash").filter("leaked"), "split")


@query(O.BALANCE_CAP_DOCS)
def balance_cap_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.cap_docs(documents(spark, sf_dir).select("id", "label"), 30, offset=3).select("id", "label")


@query(O.BALANCE_OVERSAMPLE)
def balance_cap_docs_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("id", F.col("modality").alias("label"))
    return balance.cap_docs(docs, 200, oversample=True).select("id", "label")


@query(O.BALANCE_CAP_TOKENS)
def balance_cap_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("id", "label", T.token_count("text").alias("tokens"))
    return balance.cap_tokens(docs, 25_000, offset=1).select("id", "label")


@query(O.ALPHA_QUOTAS)
def alpha_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.counts(documents(spark, sf_dir), "modality").withColumnRenamed("modality", "label")
    return balance.alpha_quotas(counts, 0.5, 777)


@query(O.BALANCE_ALPHA_TOTAL)
def balance_alpha_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("id", F.col("modality").alias("label"))
    return balance.alpha_total(docs, 0.3, 600).select("id", "label")


@query(O.CLASS_WEIGHTS)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.counts(documents(spark, sf_dir), "modality").withColumnRenamed("modality", "label")
    return balance.class_weights(counts).select("label", six("weight"))


# --- aggregates and statistics


@query(O.LABEL_COUNTS_BY_SPLIT)
def label_counts_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts(splits.three_way(documents(spark, sf_dir).select("id", "label")), "split", "label")


@query(O.MODALITY_COUNTS)
def modality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts(documents(spark, sf_dir), "modality")


@query(O.LABEL_DISTRIBUTION)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.label_distribution(documents(spark, sf_dir))


@query(O.LENGTH_PERCENTILES)
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_percentiles(documents(spark, sf_dir)).select("label", "n", six("median"), six("p90"))


@query(O.DUPLICATES_PER_LABEL)
def duplicates_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.duplicates_per_label(documents(spark, sf_dir))


@query(O.DOCLEN_HISTOGRAM)
def doclen_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_histogram(documents(spark, sf_dir)).select("corpus_id", "bin", "n", six("x_limit"))


@query(O.ROBUST_LIMITS)
def robust_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return stats.robust_limits(v, "x", "y").select("column", six("low"), six("high"))


@query(O.TOP_SOURCES)
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.most_common(documents(spark, sf_dir), "label", 10)


@query(O.CHECK_STATS)
def check_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.check_stats(documents(spark, sf_dir))


# --- metrics


@query(O.ACCURACY_MACRO_F1)
def accuracy_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(predictions(spark, sf_dir)).select("n", six("accuracy"), six("macro_f1"))


@query(O.CLASSIFICATION_REPORT)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report(predictions(spark, sf_dir)).select("class", *[six(c) for c in ("precision", "recall", "f1", "support")])


@query(O.GROUPED_METRICS)
def grouped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grouped(predictions(spark, sf_dir), ["corpus_id", "modality", "crawl"]).select("field", "value", "n", six("accuracy"), six("macro_f1"))


@query(O.BALANCED_SUMMARY)
def balanced_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = metrics.grouped(predictions(spark, sf_dir), ["modality"])
    weights = spark.createDataFrame([("web", 3.0), ("radio", 2.0), ("asr", 1.0)], "value string, weight double")
    return metrics.balanced_summary(groups, "modality", weights).select(six("balanced_accuracy"), six("balanced_macro_f1"), "groups")


@query(O.CONFUSION_MATRIX)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predictions(spark, sf_dir)).select("true", "pred", "n", six("row_share"))


@query(O.TOP_CONFUSIONS)
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_confusions(predictions(spark, sf_dir)).select("count", six("row_share"), "true", "pred")


@query(O.CONFUSION_BARS)
def confusion_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_bars(predictions(spark, sf_dir), 5)


# --- audits


def _job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir)
    return rows.unionByName(rows.filter("split = 'test'").withColumn("split", F.lit("job")))


@query(O.SPLIT_AUDIT)
def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.split_counters(_job(spark, sf_dir), key="text_hash")


@query(O.SPLIT_OVERLAP)
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.split_overlap(_job(spark, sf_dir), key="text_hash").withColumn("sample_ids", F.array_join("sample_ids", ","))


@query(O.SPLIT_ALIAS)
def split_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.split_alias(_job(spark, sf_dir), key="text_hash")


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the columns of an audited corpus; every 7th lacks its id, every 11th has a segments block."""
    d = documents(spark, sf_dir)
    doubled = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" "), "text")).otherwise(F.col("text"))
    return d.select(
        "pos", F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("d"), (F.col("doc_id") % 900).cast("string"))).alias("xml_id"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("MAIL"), F.col("label"))).otherwise(F.array(F.lit("the"))).alias("domains"),
        F.array(F.lit("example.com")).alias("crawls"), F.array(F.struct(F.lit("s").alias("scheme"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("tion"), F.col("modality"))).otherwise("").alias("value"))).alias("class_codes"),
        doubled.alias("text_all"), F.col("text").alias("text_no_segments"), F.lit(True).alias("has_text"), (F.col("doc_id") % 11 == 0).alias("has_segments"),
    )


@query(O.CORPUS_AUDIT)
def corpus_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.corpus_counters(_extracted(spark, sf_dir))


@query(O.DOC_ISSUES)
def doc_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.document_issues(_extracted(spark, sf_dir))


@query(O.DOMAIN_PURITY)
def domain_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.domain_purity(_extracted(spark, sf_dir)).withColumn("purity_ratio", F.round("purity_ratio", 6))


@query(O.METADATA_IN_TEXT)
def metadata_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.document_flags(_extracted(spark, sf_dir)).select("pos", "domain_in_text", "crawl_in_text", "classcode_in_text")


@query(O.DUPLICATE_PAIRS)
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_pairs(documents(spark, sf_dir), "doc_id")


# --- sets


@query(O.CORPUS_UNION)
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    chats = read(spark, sf_dir, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("id"), "text")
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench__"), F.col("item_id").cast("string")).alias("id"), "text")
    return sets.corpus_union({"docs": docs, "chats": chats, "bench": items}).select("corpus_id", "id", F.length("text").alias("n_chars"))


@query(O.LABEL_UNION)
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return sets.label_union(p, p.select(F.col("prediction").alias("label")))


@query(O.COMMON_TEXTS)
def common_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(T.text_hash("text").alias("h"))
    b = read(spark, sf_dir, "documents").filter("doc_id % 2 = 1").select(T.text_hash("text").alias("h"))
    return sets.common_values(a, b, "h")


@query(O.SAME_SET)
def same_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return sets.same_set(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "source")


# --- formats, features, models


@query(O.ONE_HOT_CATS)
def one_hot_cats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.col("modality").alias("label"))
    return reports.one_hot(docs, ["de", "en", "es", "fr"]).select("doc_id", F.explode("cats").alias("category", "score"))


@query(O.TFIDF_TERMS)
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "benchmark")
    return features.tfidf(docs, "item_id", "text", (1, 2), min_df=2).select("id", "term", six("weight"))


@query(O.TFIDF_TOP)
def tfidf_document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of single words over all documents, summed by term."""
    weights = features.tfidf(documents(spark, sf_dir), "doc_id", "text", (1, 1), min_df=5)
    return weights.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query(O.TFIDF_VOCABULARY)
def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100,000 most frequent words and pairs of words."""
    return features.vocabulary(documents(spark, sf_dir), "text", (1, 2), 5, 100_000)


def _predicted(spark: SparkSession, sf_dir: str, kind: str, max_features: int = 50_000, **params) -> DataFrame:
    """Predictions of the held-out fifth by a model of words and pairs of words."""
    docs = documents(spark, sf_dir).select("id", "doc_id", F.col("modality").alias("label"))
    # Only ids and labels are ranked; texts join their split once.
    part = splits.two_way(docs, 0.8).select(F.col("doc_id").alias("_doc"), "label", "split")
    texts = documents(spark, sf_dir).select("id", "doc_id", "text")
    docs = texts.join(checkpointed(part), F.col("doc_id") == F.col("_doc")).drop("_doc")
    model = models.train(docs.filter("split = 'train'"), models.Settings(kind, kind, params, (1, 2), max_features, 5))
    return models.predict(model, docs.filter("split = 'test'")).select("doc_id", "label", "prediction")


@query()
def svm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, "LinearSVC", 100_000, C=1.0, class_weight="from_balance")


@query()
def svm_rbf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, "SVC", C=1.0, gamma="scale", class_weight="from_balance")


@query()
def perceptron_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, "Perceptron", max_iter=50, tol=1e-3, class_weight="balanced")


@query()
def tree_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, "DecisionTreeClassifier", max_depth=30, min_samples_split=10, min_samples_leaf=4, class_weight="balanced")


@query()
def forest_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, "RandomForestClassifier", n_estimators=200, max_depth=25, min_samples_leaf=3, class_weight="balanced")


@query()
def svd_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fitted = features.fit_vectorizer(docs, max_features=50_000)
    return models.project_2d(fitted.transform(docs), ident="doc_id")


# --- TEI


def _as_tei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as TEI elements, with terms, a class code and a segments block."""
    d = documents(spark, sf_dir)
    safe = F.regexp_replace(T.text_of("text"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    escaped = F.replace(F.replace(F.replace(safe, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    element = F.concat(
        F.lit('<TEI xml:id="d'), "id", F.lit('"><teiHeader><term type="crawl"> '), "label", F.lit(' </term><term type="modality">'), "modality",
        F.lit('</term><classCode scheme="asr_party">p'), (F.col("doc_id") % 4).cast("string"), F.lit("</classCode></teiHeader><text><p>"), escaped, F.lit('</p><ab type=" Segments ">gone</ab>tail</text></TEI>'),
    )
    return tei.extract(d.select("pos", element.alias("frag")))


@query(O.TEI_EXTRACT)
def tei_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _as_tei(spark, sf_dir)
    return docs.select("pos", "xml_id", tei.first_term(["ideology", "crawl"]).alias("label_raw"), tei.modality("web").alias("modality"), tei.term("domain").alias("domain"), F.md5(T.text_key("text_no_segments")).alias("text_md5"))
