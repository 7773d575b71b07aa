"""Every registered query against its SQL, and the contract of those without."""

import pytest

from routeloom.llm.registry import ORACLE_SQL, QUERIES
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df())


CONTRACT = {
    "op1_urls": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op3_merkle": {
        "doc_id": "bigint",
        "n_chars": "bigint",
        "edited_sha256": "string",
        "fingerprint": "string",
        "edited_fingerprint": "string",
        "near_edited": "double",
        "near_next": "double",
    },
    "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_sharding": {
        "doc_id": "bigint",
        "size": "bigint",
        "text_crc32": "bigint",
        "law": "string",
        "shard": "int",
        "slot": "bigint",
        "grown_shard": "int",
    },
    "op8_substrings": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op9_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op10_pii": {
        "doc_id": "bigint",
        "n_email": "bigint",
        "n_ip": "bigint",
        "n_card": "bigint",
        "n_phone": "bigint",
        "base_sha256": "string",
        "spans": "string",
    },
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_rows(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    types = dict(found.dtypes)
    assert {k: types[k] for k in CONTRACT[name]} == CONTRACT[name]
    whole = spark.read.parquet(f"{sf_dir}/{'pages' if 'page_id' in types else 'documents'}.parquet")
    key = "page_id" if "page_id" in types else "doc_id"
    assert sorted(r[0] for r in found.select(key).collect()) == sorted(r[0] for r in whole.select(key).collect())


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
