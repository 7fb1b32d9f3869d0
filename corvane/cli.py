"""Command line: prepare, train, evaluate, run, aggregate, audit and stats."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .functions.text import text_hash
from .operators import audit, models, stats
from .plans import pipeline
from .sources import reports, tei, tsv


def session(name: str = "corvane") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corvane", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("prepare", "train", "evaluate", "run"):
        p = sub.add_parser(name)
        p.add_argument("--profile", required=True)
        p.add_argument("--configs", default="configs")
        p.add_argument("--override", action="append", default=[], metavar="A.B=VALUE")
        p.add_argument("--only-family", choices=models.FAMILIES)
        p.add_argument("--data", default="data/interim")
        p.add_argument("--models", default="models")
        p.add_argument("--reports", default="reports")
        p.add_argument("--legacy", action="store_true")
        p.add_argument("--dry-run", action="store_true")
        p.add_argument("--verbose", action="store_true")
    p = sub.add_parser("aggregate")
    p.add_argument("--reports", default="reports")
    p.add_argument("--out", default="reports/summary.tsv")
    p = sub.add_parser("audit-tei")
    p.add_argument("path")
    p.add_argument("--name", default="corpus")
    p.add_argument("--issues")
    p.add_argument("--out-json")
    p.add_argument("--fail-on-critical", action="store_true")
    p = sub.add_parser("audit-splits")
    p.add_argument("folder")
    p.add_argument("--out-json")
    p.add_argument("--fail-on-leak", "--strict", action="store_true")
    p = sub.add_parser("stats")
    p.add_argument("tsv", nargs="+")
    p.add_argument("--out-prefix")
    return top


def audit_corpus(spark: SparkSession, path: str, issues: str | None = None) -> tuple[dict, list[str]]:
    """The summary of a corpus and what is critical about it; only elements in the TEI namespace count."""
    docs = tei.audited(tei.scan(spark, path).filter("not broken AND in_namespace")).persist()
    whole = audit.corpus_summary(docs).first().asDict()
    summary = {k: v for k, v in whole.items() if k not in audit.PURITY_COLUMNS} | {"domain_label_purity": {k: whole[k] for k in audit.PURITY_COLUMNS}}
    for name, column in (("top_domains", "domains"), ("top_crawls", "crawls"), ("top_modalities", "modalities")):
        summary[name] = [list(r) for r in stats.most_common(docs.select(F.explode(column).alias("v")), "v").collect()]
    codes = docs.select(F.explode("class_codes").alias("c")).select(F.concat_ws(" ", "c.scheme", "c.value").alias("v"))
    summary["top_classcodes"] = [list(r) for r in stats.most_common(codes, "v").collect()]
    summary["sample_duplicate_pairs"] = [list(r) for r in audit.duplicate_pairs(docs.withColumn("text", F.col("text_all")), "xml_id").collect()]
    if issues:
        reports.write_table(audit.document_issues(docs), issues, ",")
    return summary, audit.critical_flags(whole)


def audit_splits(spark: SparkSession, folder: str) -> dict:
    """Counters of a folder's splits, and what any two of them share; a job split that is the test split again shares nothing."""
    rows, columns = tsv.read_audited(spark, {s: f"{folder}/{s}.tsv" for s in ("train", "dev", "test", "job")})
    rows = rows.select("split", "id", F.when(F.col("text") != "", text_hash("text")).alias("hash")).persist()
    alias = {"job", "test"} <= set(columns) and bool(audit.split_alias(rows, key="hash").first()[0])
    counters = {r["split"]: r.asDict() for r in audit.split_counters(rows, key="hash").collect()}
    splits = {s: {"rows": 0, "unique_ids": 0, "unique_text_hash": 0, **{k: v for k, v in counters.get(s, {}).items() if k != "split"}, "columns": c, **({"alias_of": "test"} if alias and s == "job" else {})} for s, c in columns.items()}
    compared = [s for s in columns if not (alias and s == "job")]
    shared = {frozenset((r["a"], r["b"])): r for r in audit.split_overlap(rows.filter(F.col("split").isin(compared)), key="hash").collect()}
    overlap = []
    for i, a in enumerate(compared):
        for b in compared[i + 1 :]:
            found = shared.get(frozenset((a, b)))
            overlap.append({"pair": f"{a}__{b}", "id_overlap": found["id_overlap"] if found else 0, "text_hash_overlap": found["text_hash_overlap"] if found else 0, "sample_ids": list(found["sample_ids"]) if found else []})
    rows.unpersist()
    return {"dir": folder, "splits": splits, "job_is_test_alias": alias, "overlap": overlap, "leak_detected": any(o["id_overlap"] or o["text_hash_overlap"] for o in overlap)}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    if args.command == "aggregate":
        pipeline.aggregate(spark, args.reports, args.out)
        return 0
    if args.command == "audit-tei":
        summary, critical = audit_corpus(spark, args.path, args.issues)
        found = {"corpus": args.name, **summary, "critical": critical}
        print(json.dumps(found, ensure_ascii=False, indent=2))
        if args.out_json:
            reports.write_json(spark, args.out_json, found)
        return 2 if critical and args.fail_on_critical else 0
    if args.command == "audit-splits":
        try:
            found = audit_splits(spark, args.folder)
        except FileNotFoundError as e:
            print(f"no split to audit: {e}", file=sys.stderr)
            return 2
        print(json.dumps(found, ensure_ascii=False, indent=2))
        if args.out_json:
            reports.write_json(spark, args.out_json, found)
        if found["leak_detected"]:
            print("splits share ids or texts", file=sys.stderr)
        return 2 if found["leak_detected"] and args.fail_on_leak else 0
    if args.command == "stats":
        rows = None
        for path in args.tsv:
            part = tsv.read_positional(spark, path)
            rows = part if rows is None else rows.unionByName(part)
        rows = rows.withColumn("pos", F.monotonically_increasing_id()).persist()
        labels = stats.label_distribution(rows).select("label", F.col("n").alias("count"))
        again = reports.counts_of(stats.duplicates_per_label(rows), "label", "duplicates")
        lengths = {r["label"]: {"n": r["n"], "median": r["median"], "p90": r["p90"]} for r in stats.length_percentiles(rows).collect()}
        found = {"docs": rows.count(), "labels": labels.count(), "dups_total": sum(again.values()), "dups_per_label": again, "length_tokens": lengths}
        print(json.dumps(found, ensure_ascii=False, indent=2))
        if args.out_prefix:
            reports.write_table(labels, f"{args.out_prefix}.label_dist.csv", ",")
            reports.write_json(spark, f"{args.out_prefix}.stats.json", found)
        return 0
    profile = config.load(args.configs, args.profile, args.override, args.legacy)
    if args.verbose:
        print(profile, file=sys.stderr)
    fitted: dict = {}
    if args.command in ("prepare", "run"):
        pipeline.prepare(spark, profile, args.data, dry_run=args.dry_run)
        if not args.dry_run:
            pipeline.formats(spark, profile, args.data)
    if args.command in ("train", "run") and not args.dry_run:
        fitted = pipeline.train(spark, profile, args.data, args.models, args.only_family)
    if args.command in ("evaluate", "run") and not args.dry_run:
        if args.command == "evaluate":
            for family, model_id in pipeline.chosen(profile, args.only_family):
                if family != "check":
                    path = f"{args.models}/{profile.dataset_id}/{profile.view}/{family}/{model_id}"
                    fitted[model_id] = pipeline.saved_model(spark, path, models.settings_of(model_id, profile.models, family))
        pipeline.evaluate(spark, profile, args.data, fitted, args.reports, args.only_family)
    return 0


if __name__ == "__main__":
    sys.exit(main())
