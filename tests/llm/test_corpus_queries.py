"""Registered corpus queries: checking SQL where there is some, else their columns and a row per document."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from pageprism.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op2_chat_windows": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op3_minhash_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_quality": {"doc_id", "score", "kept"},
    "op7_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op11_ngram_join": {"doc_id", "n_shingles", "component_id"},
    "op12_conversation_repair": {
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
    },
    "op13_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op8_url_filter": {"page_id", "host", "path", "rule", "verdict"},
}


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, sf, name):
    assert compare(spark, connect(sf), QUERIES[name], SQL[name], sf)[0] == "ok"


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, sf, name):
    out = QUERIES[name](spark, sf)
    assert COLUMNS[name] <= set(out.columns)
    if "piece" not in out.columns:
        table = {"op2": "conversations", "op8": "pages", "op12": "conversations"}.get(name.split("_")[0], "documents")
        given = spark.read.parquet(f"{sf}/{table}.parquet")
        want = given.select("conv_id").distinct().count() + (name == "op2_chat_windows") if table == "conversations" else given.count()
        assert out.count() == want
