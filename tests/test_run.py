import json
import shutil

import yaml

from corvane import cli, config
from corvane.plans import pipeline
from corvane.streaming import prepare as streaming


def _corpus(path, n, prefix):
    words = {"left": "red fair share union", "right": "order border tax nation"}
    parts = []
    for i in range(n):
        side = "left" if i % 2 else "right"
        text = " ".join(words[side].split()[(i + k) % 4] for k in range(6)) + f" w{i % 17} v{i % 13}"
        parts.append(f'<TEI xml:id="{prefix}{i}"><term type="crawl">{side}{i % 3}</term><term type="domain">{side}.example.org</term><text><p>{text}</p></text></TEI>')
    path.write_text(f'<teiCorpus xmlns="http://www.tei-c.org/ns/1.0">{"".join(parts)}</teiCorpus>')


def test_profile_from_corpus_to_summary(spark, tmp_path):
    for name in ("web", "asr"):
        _corpus(tmp_path / f"{name}.xml", 80, name[0])
    actors = {"actors": {s: {"crawls": [f"{s}{i}" for i in range(3)], "side_binary": s} for s in ("left", "right")}}
    (tmp_path / "actors.yml").write_text(yaml.safe_dump(actors))
    model = {"estimator": {"class": "svm.LinearSVC", "params": {"C": 1.0, "class_weight": "from_balance"}}, "vectorizer": {"params": {"ngram_range": [1, 2], "min_df": 2}}}
    files = {
        "common/corpora": {n: {"corpus_id": n, "corpus_path": f"file://{tmp_path}/{n}.xml", "default_modality": n} for n in ("web", "asr")},
        "common/balance": {}, "common/hardware": {"presets": {"small": {"max_train_docs_sklearn": 1000}}}, "common/models": {"families": {"sklearn": {"svm": model}}},
        "profiles/mix": {"profile": "mix", "corpora": ["web", "asr"], "view": "ideo", "ideology": {"view": "binary", "actors_yaml": str(tmp_path / "actors.yml")}, "train": {"train_prop": 0.6}, "dedup_on": "text", "normalize": {"mode": "basic", "redact_meta_tokens": True}, "balance_strategy": "class_weights", "families": ["check", "sklearn", "spacy"], "models_sklearn": ["svm"], "analysis": {"compare_by": ["corpus_id", "modality"]}},
    }
    for name, content in files.items():
        target = tmp_path / "configs" / f"{name}.yml"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(yaml.safe_dump(content))
    profile = config.load(str(tmp_path / "configs"), "mix")
    out = f"file://{tmp_path}"
    meta = pipeline.prepare(spark, profile, f"{out}/data")
    assert set(meta["label_counts_before"]) == {"left", "right"} and meta["n_docs_raw"] <= 160 and set(meta["label_weights"]) == {"left", "right"}
    assert json.loads((tmp_path / "data/mix/ideo/meta_view.json").read_text())["n_docs_test"] == meta["n_docs_test"]
    assert pipeline.formats(spark, profile, f"{out}/data")["cats"]["labels"] == ["left", "right"]
    fitted = pipeline.train(spark, profile, f"{out}/data", f"{out}/models")
    found = pipeline.evaluate(spark, profile, f"{out}/data", fitted, f"{out}/reports")
    assert found["svm"]["accuracy"] > 0.9 and found["svm"]["balanced_accuracy_by_corpus_id"] > 0.9
    summary = {r.model_id: r for r in pipeline.aggregate(spark, f"{out}/reports", f"{out}/summary").collect()}
    assert summary["svm"].profile == "mix" and float(summary["svm"].accuracy) == found["svm"]["accuracy"]
    args = ["--profile", "mix", "--configs", str(tmp_path / "configs"), "--data", f"{out}/data", "--models", f"{out}/models", "--reports", f"{out}/reports2"]
    assert cli.main(["evaluate", *args]) == 0 and (tmp_path / "reports2/mix/ideo/sklearn/svm/metrics.json").exists()
    assert cli.main(["audit-tei", f"{out}/web.xml", "--fail-on-critical"]) == 0
    assert cli.main(["audit-splits", f"{out}/data/mix/ideo"]) == 0
    assert cli.main(["audit-tei", f"{out}/web.xml", "--out-json", f"{out}/audit.json"]) == 0 and json.loads((tmp_path / "audit.json").read_text())["n_docs"] == 80
    assert cli.main(["stats", f"{out}/data/mix/ideo/train.tsv", "--out-prefix", f"{out}/st"]) == 0
    assert json.loads((tmp_path / "st.stats.json").read_text())["docs"] > 0
    assert next((tmp_path / "st.label_dist.csv").glob("part*")).read_text().startswith("label,count")
    assert meta["n_docs_broken"] == {}
    # TSV files only, and neither test nor dev rows.
    shutil.rmtree(tmp_path / "data/mix/ideo/view.parquet")
    shutil.rmtree(tmp_path / "data/mix/ideo/test.tsv")
    shutil.rmtree(tmp_path / "data/mix/ideo/job.tsv")
    assert pipeline.evaluation_rows(spark, f"{out}/data/mix/ideo")[0] == "dev"
    assert pipeline.training_rows(spark, f"{out}/data/mix/ideo").count() == meta["n_docs_train_balanced"]
    assert cli.main(["audit-splits", f"{out}/data/mix/ideo"]) == 0 and cli.main(["audit-splits", f"{out}/nothing"]) == 2


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) id", "text", "source label_raw", "lang modality", "timestamp_seconds(doc_id * 60) ts")
    src.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streaming.write_stream(streaming.prepare_stream(stream, "basic", 200, 600, "en"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    batch = streaming.prepare_stream(src, "basic", 200, 600, "en")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == batch.count() > 0 and out.select(*batch.columns).exceptAll(batch).count() == 0
    one = streaming.dedup_stream(stream, delay="365 days")
    q = streaming.write_stream(one, f"{tmp_path}/out2", f"{tmp_path}/cp2")
    q.awaitTermination(120)
    texts = src.selectExpr("text").distinct().count()
    assert 0 < spark.read.parquet(f"{tmp_path}/out2").count() <= texts
    counted = streaming.label_counts(stream.withColumnRenamed("label_raw", "label"))
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM counted").first()[0] == src.count()
