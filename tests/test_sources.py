import json

import pytest
import yaml
from pyspark.sql import functions as F

from corvane import cli
from corvane.operators import audit
from corvane.sources import dims, reports, tei, tsv

TEI = """<?xml version="1.0"?>
<teiCorpus xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>x &lt;TEI&gt;</title></teiHeader>
<TEI xml:id="a"><teiHeader><term type="crawl"> </term><term type="crawl"> C1 </term><term type="domain">site.example.org</term></teiHeader><text><p>One<hi>two</hi> three</p> see site.example.org</text></TEI>
<TEI n="b"><teiHeader><classCode scheme="asr_party">P</classCode></teiHeader><text><p>kept</p><ab type=" Segments ">gone <w>too</w></ab>tail</text></TEI>
<TEI><text><![CDATA[raw & ]]><!-- c -->more</text></TEI>
<TEI xml:id="a"><teiHeader><term type="modality">asr</term></teiHeader><body>no text node</body></TEI>
<TEI xml:id="e"><text><p>kept</p><ab type="segments">kept kept kept kept</ab></text></TEI>
</teiCorpus>
"""


@pytest.fixture
def corpus(tmp_path):
    path = tmp_path / "corpus.xml"
    path.write_text(TEI, encoding="utf-8")
    return str(path)


def test_prepared(spark, corpus):
    docs = tei.prepared(tei.scan(spark, corpus), ["ideology", "crawl"], "web", drop_segments=True)
    rows = {r.pos: r for r in docs.collect()}
    got = [(rows[p].id, rows[p].label_raw, rows[p].modality, rows[p].domain, rows[p].text) for p in sorted(rows)]
    assert got == [
        ("a", "C1", "web", "site.example.org", "One two three see site.example.org"),
        ("b", "asr_party:P", "web", "asr_party:P", "kept tail"),
        ("doc_2", None, "web", None, "raw & more"),
        ("a", None, "asr", None, "asr no text node"),
        ("e", None, "web", None, "kept"),
    ]
    only_asr = tei.prepared(tei.scan(spark, corpus), ["crawl"], "web", drop_segments=True, segment_modalities=["asr"], party_fallback=False)
    assert {r.text for r in only_asr.filter("id = 'b'").collect()} == {"kept gone too tail"}
    assert only_asr.filter("domain IS NOT NULL").count() == 1


def test_prefixed(spark, tmp_path):
    path = tmp_path / "p.xml"
    path.write_text('<t:teiCorpus xmlns:t="http://www.tei-c.org/ns/1.0"><t:TEI xml:id="q"><t:text>hi</t:text></t:TEI></t:teiCorpus>')
    assert [(r.xml_id, r.text) for r in tei.scan(spark, str(path)).collect()] == [("q", "hi")]
    assert tei.parse("<TEI><broken></TEI>")["broken"]


def test_numbers_and_broken_documents(spark, tmp_path):
    """Documents without an id get numbers of their own, whatever stands between them; other namespaces are told."""
    parts = ["<TEI><text>one</text></TEI>", "<TEI><text><p>broken</text></TEI>", "<TEI><text>two</text></TEI>", '<TEI xmlns="urn:x"><text>three</text></TEI>']
    for name in ("a", "b"):
        (tmp_path / f"{name}.xml").write_text(f'<teiCorpus xmlns="http://www.tei-c.org/ns/1.0">{"".join(parts)}</teiCorpus>')
    docs = tei.prepared(tei.scan(spark, str(tmp_path)), ["crawl"])
    rows = docs.filter("NOT broken").collect()
    assert sorted(r.id for r in rows) == ["doc_0", "doc_2", "doc_3", "doc_4", "doc_6", "doc_7"] and docs.filter("broken").count() == 2
    assert sorted(r.text for r in tei.scan(spark, str(tmp_path)).filter("in_namespace").collect()) == ["one", "one", "two", "two"]


def test_prefix_far_from_the_beginning(spark, tmp_path):
    header = "<t:teiHeader>" + "<t:note>n</t:note>" * 300 + "</t:teiHeader>"
    (tmp_path / "a.xml").write_text(f'<t:teiCorpus xmlns:t="http://www.tei-c.org/ns/1.0">{header}<t:TEI><t:text>hi</t:text></t:TEI></t:teiCorpus>')
    assert [r.text for r in tei.scan(spark, str(tmp_path)).collect()] == ["hi"]
    (tmp_path / "a.xml").write_text('<t:teiCorpus xmlns:t="http://www.tei-c.org/ns/1.0"><t:TEI/><t:TEI><t:text>hi</t:text></t:TEI><TEI><text>lost?</text></TEI></t:teiCorpus>')
    with pytest.raises(Exception, match="another prefix"):
        tei.scan(spark, str(tmp_path)).collect()


def test_files_have_roots_of_their_own(spark, tmp_path):
    """Declarations that only a later file has, and prefixes that differ, in names that need quoting."""
    many = "".join(f"<TEI><text>a{i}</text></TEI>" for i in range(80))
    (tmp_path / "a.xml").write_text(f'<teiCorpus xmlns="http://www.tei-c.org/ns/1.0">{many}</teiCorpus>')
    (tmp_path / "b.xml").write_text('<teiCorpus xmlns="http://www.tei-c.org/ns/1.0" xmlns:x="urn:x"><TEI><text>b<x:note>c</x:note></text></TEI></teiCorpus>')
    docs = tei.scan(spark, str(tmp_path))
    assert docs.filter("broken").count() == 0 and docs.filter("in_namespace").count() == 81
    for i in range(10):
        p = f"p{i}:" if i % 3 else ""
        root = f'<{p}teiCorpus xmlns{":" if p else ""}{p[:-1]}="http://www.tei-c.org/ns/1.0" xmlns:y{i}="urn:{i} &gt; TEI">'
        (tmp_path / f"c {i}%.xml").write_text(f"<!-- {i} -->{root}" + f'<{p}TEI xml:id="d{i}"><{p}text y{i}:k="v">t{i}</{p}text></{p}TEI>' * 2 + f"</{p}teiCorpus>")
    docs = tei.scan(spark, str(tmp_path))
    rows = docs.collect()
    assert len(rows) == 101 and not any(r.broken for r in rows) and all(r.in_namespace for r in rows)
    assert sorted(r.text for r in rows) == sorted([f"a{i}" for i in range(80)] + ["b c"] + [f"t{i}" for i in range(10)] * 2)
    assert sorted(r.idx for r in rows) == list(range(101))


def test_audit(spark, corpus):
    docs = tei.audited(tei.scan(spark, corpus))
    c = audit.corpus_counters(docs).first().asDict()
    assert (c["n_docs"], c["missing_xml_id"], c["duplicate_xml_id"], c["missing_text_node"], c["empty_text_docs"]) == (5, 2, 1, 1, 1)
    assert (c["segments_present_docs"], c["segments_dup_risky_docs"], c["leak_domain_in_text_docs"]) == (1, 1, 1)
    issues = {(r.xml_id, r.issues) for r in audit.document_issues(docs).collect()}
    assert ("e", "segments_dup_risky") in issues and ("a", "domain_in_text") in issues and ("a", "empty_text_all") in issues
    whole = audit.corpus_summary(docs).first().asDict()
    assert {k: whole[k] for k in audit.PURITY_COLUMNS} == audit.domain_purity(docs).first().asDict()
    assert audit.corpus_summary(docs.limit(0)).first()["n_docs"] == 0
    assert set(audit.critical_flags(whole)) == {"duplicate_xml_id", "segments_dup_risky"}


def test_tsv_round_trip(spark, tmp_path):
    rows = [("1", "1", "l", None, "web", "c", 'a "quoted"\ttab\nline \\ back'), ("2", "2", "", "r", "web", "c", "x"), ("3", "3", "l", "", "web", "c", ""), ("4", "4", "l", "", "asr", "c", "é" * 200_000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in tsv.COLUMNS)).withColumn("split", F.when(F.col("id") == "4", "test").otherwise("train"))
    folder = f"file://{tmp_path}/view"
    tsv.write_splits(df, folder)
    back = {r.id: r for r in tsv.read_split(spark, f"{folder}/train.tsv").collect()}
    assert back["1"].text == rows[0][6] and back["1"].label_raw == "" and len(back) == 3
    train = tsv.read_training(spark, folder)
    assert [r.id for r in train["train"].collect()] == ["1"] and [r.id for r in train["job"].collect()] == ["4"]
    assert tsv.read_evaluation(spark, folder)[0] == "test"
    assert tsv.stripped(tsv.read_tsv(spark, f"{folder}/train.tsv")).count() == 2
    assert tsv.sniff(["a", "content", "doc_id"]) == ("content", "doc_id") and tsv.sniff(["a", "b"]) == ("b", None)
    assert tsv.read_positional(spark, f"{folder}/test.tsv").columns == ["text", "label"]
    assert tsv.read_audited(spark, {s: f"{folder}/{s}.tsv" for s in ("train", "test")})[0].count() == 4
    with pytest.raises(FileNotFoundError):
        tsv.read_evaluation(spark, f"file://{tmp_path}/none")


def test_label_maps(spark, tmp_path):
    path = tmp_path / "m.yml"
    path.write_text(yaml.safe_dump({"mapping": {"A-B": "x", "a b": "y", "c": None, "d": " "}, "unknown_labels": {"policy": "keep"}}))
    table, unknown = dims.read_label_map(spark, str(path))
    assert [tuple(r) for r in table.collect()] == [("a_b", "y")] and unknown == {"policy": "keep"}
    assert dims.label_map({"k": "v", "unknown_labels": {"policy": "drop"}})[0] == [("k", "v")]
    bridge, actors = dims.actor_tables(spark, {"p": {"crawls": ["X"], "domains": ["d"], "side_binary": "left"}, "q": {"crawls": ["x"]}, "r": None})
    assert {tuple(r) for r in bridge.select("kind", "key", "actor_id").collect()} == {("crawl", "x", "q"), ("domain", "d", "p")}
    assert actors.count() == 3


def test_summary(spark, tmp_path):
    for model, metrics, meta in (("m1", '{"accuracy": 0.5, "macro_f1": 0.25}', {"profile": "p", "n_eval_docs": 3}), ("m2", "not json", None)):
        folder = tmp_path / "corpus" / "view" / "sk" / model
        folder.mkdir(parents=True)
        (folder / "metrics.json").write_text(metrics)
        if meta:
            (folder / "meta_eval.json").write_text(json.dumps(meta))
    rows = {r.model_id: r for r in reports.run_summary(spark, f"file://{tmp_path}").collect()}
    assert (rows["m1"].corpus_id, rows["m1"].view, rows["m1"].accuracy, rows["m1"].n_eval_docs, rows["m2"].accuracy) == ("corpus", "view", "0.5", "3", "")
    assert tuple(reports.run_summary(spark, f"file://{tmp_path}").columns) == reports.SUMMARY


def test_split_audit(spark, tmp_path, capsys):
    """A file of its own columns, rows without ids, empty texts, a job split that is the test split, and the exit status."""
    folder = f"file://{tmp_path}"
    files = {
        "train": "id\ttext\n1\tOne text\n2\tsecond\n\tno id\n3\t\n", "dev": "doc_id\tcontent\n7\tONE  text!\n\tother\n8\t\n",
        "test": "id\ttext\n2\tthird\n9\tfourth\n", "job": "id\ttext\n9\tfourth\n2\tthird\n",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.tsv").write_text(content)
    found = cli.audit_splits(spark, folder)
    assert found["splits"]["dev"] == {"rows": 3, "unique_ids": 3, "unique_text_hash": 2, "columns": {"id": "doc_id", "text": "content"}}
    assert found["splits"]["train"]["unique_text_hash"] == 3 and found["splits"]["job"]["alias_of"] == "test" and found["job_is_test_alias"]
    pairs = {o["pair"]: (o["id_overlap"], o["text_hash_overlap"], o["sample_ids"]) for o in found["overlap"]}
    assert pairs == {"train__dev": (0, 1, []), "train__test": (1, 0, ["2"]), "dev__test": (0, 0, [])} and found["leak_detected"]
    assert cli.main(["audit-splits", folder, "--out-json", f"{folder}/found.json"]) == 0
    assert json.loads((tmp_path / "found.json").read_text())["overlap"] == found["overlap"]
    assert cli.main(["audit-splits", folder, "--strict"]) == cli.main(["audit-splits", folder, "--fail-on-leak"]) == 2
    (tmp_path / "train.tsv").write_text("id\ttext\n5\tnew\n")
    assert cli.main(["audit-splits", folder, "--strict"]) == 0
