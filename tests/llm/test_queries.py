import pytest

import __spark_entry__
from corvane.llm.queries import ORACLE_SQL, QUERIES

from ..duck import compare


@pytest.mark.parametrize("name", ["op2_warc", "op3_vector_search", "op6_near_dedup"])
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")


def test_every_operator_is_registered():
    known = __spark_entry__.queries()
    assert {n.split("_")[0] for n in known if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in known


def test_contract_columns(spark):
    expected = {
        "op1_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op2_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
        "op3_vector_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
        "op4_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op9_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
        "op11_power_of_two": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op12_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
        "op13_filter_audit": {"part": "string", "filter_order": "string", "step": "int", **dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint")},
    }
    for name, columns in expected.items():
        found = dict(QUERIES[name](spark, "/root/testdata/sf0.001").dtypes)
        assert {c: found.get(c) for c in columns} == columns, name
