"""The run of a profile: prepare, train, evaluate, as one application.

prepare is a lazy plan up to its splits, which are written once and read again
by every later step; every count in the metadata comes from those tables.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Profile
from ..functions.text import normalise, redact_values, text_hash
from ..operators import balance, dedup, filters, labels, metrics, models, sets, splits
from ..sources import dims, reports, tei, tsv

VERSION = "1.0"
#: Characters of a text that document classifiers are given, where a profile doesn't say.
LONGEST = 1_000_000


def read_corpora(spark: SparkSession, profile: Profile) -> DataFrame:
    """All corpora of a profile as documents: pos, id, xml_id, label_raw, modality, crawl, domain, actor, text, broken, corpus_id."""
    fields = list(profile.label_fields or ([profile.label_field] if profile.label_field else []))
    norm = profile.normalize
    parts = {}
    for c in profile.corpora:
        docs = tei.prepared(tei.scan(spark, c.corpus_path), fields, c.default_modality, bool(norm.get("drop_segments")), list(norm.get("drop_segments_modalities") or []), bool(norm.get("asr_party_fallback", True)))
        parts[c.corpus_id] = docs
    return sets.corpus_union(parts)


def with_text(docs: DataFrame, profile: Profile) -> DataFrame:
    """Texts normalised, then redacted if the profile asks for it or removes biases."""
    text = normalise("text", profile.text_mode)
    if profile.normalize.get("redact_meta_tokens") or profile.text_mode == "debias":
        text = redact_values(text, "domain", "crawl")
    return docs.withColumn("text", text)


def with_labels(docs: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame | None]:
    """Labelled documents, and the counts of reasons where actors decide."""
    spark = docs.sparkSession
    if profile.ideology:
        actors = dims.load_yaml(profile.ideology["actors_yaml"]).get("actors") or {}
        bridge, attributes = dims.actor_tables(spark, actors)
        unknown = profile.ideology.get("unknown_actors") or {}
        rows = labels.resolve_actor(docs, bridge, attributes)
        rows = labels.ideology_label(rows, profile.ideology.get("view", "binary"), unknown.get("policy", "drop"), unknown.get("label", "unknown_actor"))
        return filters.with_label(rows), labels.reason_counts(rows)
    rows = docs.filter(F.coalesce(F.col("label_raw"), F.lit("")) != "")
    if profile.label_map:
        mapping, unknown = dims.read_label_map(spark, profile.label_map)
        return labels.map_label(rows, mapping, str(unknown.get("policy", "drop")).strip().lower(), str(unknown.get("other_label", "other"))), None
    return filters.with_label(labels.direct_label(rows)), None


def select(docs: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame | None]:
    """The row-wise part in its order: modality, text, lengths, labels; then dedup, limit and actors."""
    rows = filters.by_modality(docs, profile.modality)
    rows = filters.max_tokens(filters.min_chars(with_text(rows, profile), profile.min_chars), profile.max_tokens, profile.tokenizer)
    rows, reasons = with_labels(rows, profile)
    order = F.struct("corpus_id", "pos")
    rows = rows.withColumn("pos", order)
    rows = dedup.dedup(rows, profile.dedup_on)
    rows = dedup.limit(rows, profile.max_docs_global, profile.max_docs_global_mode, profile.seed)
    if profile.actors:
        rows = filters.by_actor(rows, list(profile.actors.get("include") or []), int(profile.actors.get("min_docs") or 0))
    return rows, reasons


def split(docs: DataFrame, profile: Profile) -> DataFrame:
    return splits.three_way(docs, profile.train_prop, profile.dev_prop, profile.test_prop, profile.seed)


def prepare(spark: SparkSession, profile: Profile, out: str, docs: DataFrame | None = None, dry_run: bool = False) -> dict:
    """Prepare a view below ``out/dataset/view``: Parquet with all columns, the four TSV splits and the metadata.

    docs stand in for the profile's corpora where given; corpora are parsed
    once and written, documents that can't be parsed are only counted. Returns
    the metadata.
    """
    folder = f"{out}/{profile.dataset_id}/{profile.view or 'view'}"
    broken = {}
    if docs is None:
        read_corpora(spark, profile).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        broken = reports.counts_of(docs.filter("broken").groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n")), "corpus_id", "n")
        docs = docs.filter("NOT broken").drop("broken")
    modalities = docs.groupBy("modality").agg(F.count(F.lit(1)).alias("n"))
    rows, reasons = select(docs, profile)
    rows.write.mode("overwrite").parquet(f"{folder}/selected.parquet")
    rows = filters.require_rows(spark.read.parquet(f"{folder}/selected.parquet"))
    # Splits, leaks and balance are decided on keys; texts join the result once.
    keys = rows.select("pos", "id", "label", "tokens", text_hash("text").alias("text_hash"))
    marked = dedup.leak_marks(split(keys, profile), key="text_hash")
    marked.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/split.parquet")
    marked = spark.read.parquet(f"{folder}/split.parquet")
    clean = marked.filter("not leaked").drop("leaked", "text_hash")
    train = balance.balance(clean.filter("split = 'train'"), profile.balance_strategy, profile.preset, profile.seed)
    chosen_keys = train.unionByName(clean.filter("split <> 'train'").withColumn("id", F.col("id").cast("string"))).select("pos", "id", "split")
    whole = chosen_keys.join(rows.drop("id"), "pos")
    whole.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/view.parquet")
    whole = spark.read.parquet(f"{folder}/view.parquet")
    count = lambda df, *keys: reports.counts_of(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), *keys, "n")
    per_split = {s: count(whole.filter(F.col("split") == s), "label") for s in dedup.SPLITS}
    meta = {k: v for k, v in asdict(profile).items() if k not in ("models", "preset")}
    meta |= {
        "n_docs_raw": rows.count(), "n_docs_broken": broken, "overlap_removed": count(marked.filter("leaked"), "split"), "label_counts_before": count(rows, "label"),
        "label_counts_train_before_balance": count(clean.filter("split = 'train'"), "label"), "label_counts_train_after": per_split["train"], "label_counts_dev": per_split["dev"],
        "label_counts_test": per_split["test"], "label_counts_job": per_split["test"], "n_docs_train_balanced": sum(per_split["train"].values()), "n_docs_dev": sum(per_split["dev"].values()),
        "n_docs_test": sum(per_split["test"].values()), "n_docs_job": sum(per_split["test"].values()), "modality_counts": reports.counts_of(modalities, "modality", "n"),
        "ideology_stats": reports.counts_of(reasons, "reason", "n") if reasons is not None else {}, "engine_version": VERSION,
    }
    if profile.balance_strategy == "class_weights":
        weights = balance.class_weights(clean.filter("split = 'train'").groupBy("label").agg(F.count(F.lit(1)).alias("n")))
        meta["label_weights"] = reports.counts_of(weights, "label", "weight")
    if not dry_run:
        columns = tuple(profile.source_field if c == "corpus_id" else c for c in tsv.COLUMNS)
        named = whole if profile.source_field == "corpus_id" else whole.withColumnRenamed("corpus_id", profile.source_field)
        tsv.write_splits(named, folder, columns)
        reports.write_json(spark, f"{folder}/meta_view.json", meta)
    return meta


def formats(spark: SparkSession, profile: Profile, out: str) -> dict:
    """Documents with categories for classifiers that want them, sharded, and the manifest of all formats."""
    folder = f"{out}/{profile.dataset_id}/{profile.view or 'view'}"
    manifest = {"tsv": {s: f"{folder}/{s}.tsv" for s in ("train", "dev", "test", "job")}, "sklearn": f"{folder}/view.parquet"}
    if profile.generate_spacy_docbin or "spacy" in profile.families:
        whole = spark.read.parquet(f"{folder}/view.parquet")
        names = [r[0] for r in sets.label_union(whole).collect()]
        if profile.spacy_max_chars:
            whole = filters.long_texts(whole, profile.spacy_max_chars, profile.spacy_long_text_policy)
        shard = int(profile.hardware.get("spacy_shard_docs") or 10_000)
        for s in dedup.SPLITS:
            rows = whole.filter(F.col("split") == s)
            rows = dedup.limit(rows, profile.cap("spacy") or 0) if s == "train" else rows  # the hardware cap: the first ones
            reports.write_shards(reports.one_hot(rows, names), f"{folder}/cats/{s}.parquet", shard)
        manifest["cats"] = {s: f"{folder}/cats/{s}.parquet" for s in dedup.SPLITS} | {"labels": names}
    reports.write_json(spark, f"{folder}/meta_formats.json", manifest)
    return manifest


def chosen(profile: Profile, only: str | None = None) -> list[tuple[str, str]]:
    """(family, model) in the order of a run."""
    return [(f, m) for f in models.FAMILIES if f in profile.families and only in (None, f) for m in (getattr(profile, f"models_{f}") or (["check_default"] if f == "check" else []))]


def _view(spark: SparkSession, folder: str) -> DataFrame | None:
    """The prepared view with its columns, if it was prepared here and not elsewhere as TSV only."""
    try:
        return spark.read.parquet(f"{folder}/view.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled training rows of a prepared view, or of its train.tsv."""
    view = _view(spark, folder)
    return tsv.read_training(spark, folder)["train"] if view is None else tsv.labelled(view.filter("split = 'train'"))


def evaluation_rows(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """The split that is evaluated, and its labelled rows: test, else dev, else train; of a folder of TSV test, job, dev, train."""
    view = _view(spark, folder)
    if view is None:
        return tsv.read_evaluation(spark, folder)
    for name in ("test", "dev", "train"):
        rows = tsv.labelled(view.filter(F.col("split") == name))
        if not rows.isEmpty():
            return name, rows
    raise ValueError(f"no labelled document in {folder}")


def train(spark: SparkSession, profile: Profile, out: str, model_dir: str, only: str | None = None) -> dict[str, models.Model]:
    """Fit and save the chosen models; the checking family only counts."""
    folder = f"{out}/{profile.dataset_id}/{profile.view or 'view'}"
    rows = training_rows(spark, folder)
    if profile.debug_mode:
        rows = dedup.subsample(rows, 1000, profile.seed)
    fitted = {}
    for family, model_id in chosen(profile, only):
        target = f"{model_dir}/{profile.dataset_id}/{profile.view}/{family}/{model_id}"
        meta = {"profile": profile.profile, "description": profile.description, "dataset_id": profile.dataset_id, "corpus_id": profile.corpus_id, "view": profile.view, "family": family, "model_id": model_id, "hardware": profile.hardware, "debug_mode": profile.debug_mode, "engine_version": VERSION}
        if family == "check":
            meta["label_counts"] = reports.counts_of(metrics.check_stats(rows), "label", "n")
        else:
            settings = models.settings_of(model_id, profile.models, family)
            model = models.train(rows, settings, profile.cap(family), profile.balance_strategy, profile.seed)
            model.save(target)
            fitted[model_id] = model
            meta |= {"labels": model.labels, "kind": settings.kind, "gamma": model.gamma, "seed": model.seed}
        reports.write_json(spark, f"{target}/meta_model.json", meta)
    return fitted


def evaluate(spark: SparkSession, profile: Profile, out: str, fitted: dict[str, models.Model], report_dir: str, only: str | None = None) -> dict[str, dict]:
    """Metrics of the fitted models on the test split (of the evaluation dataset if there is one) or what stands in for it, whole and by group."""
    folder = f"{out}/{profile.eval_dataset_id or profile.dataset_id}/{profile.view or 'view'}"
    split_name, rows = evaluation_rows(spark, folder)
    if profile.debug_mode:
        rows = dedup.subsample(rows, 1000, profile.seed)
    results = {}
    for family, model_id in chosen(profile, only):
        target = f"{report_dir}/{profile.dataset_id}/{profile.view}/{family}/{model_id}"
        if family == "check":
            found = {"label_counts": reports.counts_of(metrics.check_stats(rows), "label", "n")}
            n = sum(found["label_counts"].values())
        else:
            whole = filters.long_texts(rows, profile.spacy_max_chars or LONGEST, profile.spacy_long_text_policy if profile.spacy_max_chars else "truncate") if family == "spacy" else rows
            scored = models.predict(fitted[model_id], whole).drop("text").persist()
            one = metrics.summary(scored).first()
            n = one["n"] if one else 0
            found = {"accuracy": one and one["accuracy"], "macro_f1": one and one["macro_f1"], "family": family, "model_id": model_id, "n_eval_docs": n}
            found["classification_report"] = {r["class"]: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in metrics.report(scored).collect()}
            if profile.compare_by:
                groups = metrics.grouped(scored, profile.compare_by).persist()
                reports.write_json(spark, f"{target}/metrics_grouped.json", [r.asDict() for r in groups.orderBy("field", "value").collect()])
                if "corpus_id" in profile.compare_by:
                    given = (profile.analysis.get("corpus_weights") or {}).items()
                    weights = spark.createDataFrame([(str(k), float(v)) for k, v in given], "value string, weight double") if given else None
                    b = metrics.balanced_summary(groups, "corpus_id", weights).first()
                    found |= {"balanced_accuracy_by_corpus_id": b["balanced_accuracy"], "balanced_macro_f1_by_corpus_id": b["balanced_macro_f1"]}
            scored.unpersist()
        reports.write_json(spark, f"{target}/metrics.json", found)
        reports.write_json(spark, f"{target}/meta_eval.json", {"profile": profile.profile, "dataset_id": profile.dataset_id, "eval_dataset_id": profile.eval_dataset_id or profile.dataset_id, "corpus_id": profile.corpus_id, "view": profile.view, "family": family, "model_id": model_id, "label_field": profile.label_field, "n_eval_docs": n, "split": split_name, "pipeline_version": VERSION})
        results[model_id] = found
    return results


def aggregate(spark: SparkSession, report_dir: str, out: str) -> DataFrame:
    """All metrics below a folder as one table, written."""
    summary = reports.run_summary(spark, report_dir)
    reports.write_table(summary, out)
    return summary


def saved_model(spark: SparkSession, path: str, settings: models.Settings) -> models.Model:
    """A saved model with the kernel width and the seed in its metadata."""
    gamma, seed = spark.read.text(f"{path}/meta_model.json", wholetext=True).select(F.get_json_object("value", "$.gamma"), F.get_json_object("value", "$.seed")).first()
    return models.load(path, settings, float(gamma) if gamma is not None else None, int(seed or 42))
