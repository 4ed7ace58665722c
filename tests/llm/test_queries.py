"""The registered queries: their SQL where there is one, their columns, and whole tables."""

import pytest

import corpus_pipeline
from check_catalog import connect, differences
from wattframe.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op3_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_url_filters": "page_id host path rule verdict",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_source_mixing": "doc_id size source_size target taken",
    "op12_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
}


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


def test_names_and_stages():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLE) < set(QUERIES) and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, database, name):
    assert differences(spark, database, FOLDER, name) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_for_each_row_of_the_table(spark, name):
    table, key = ("pages", "page_id") if name in ("op4_url_filters", "op9_warc") else ("documents", "doc_id")
    rows = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(rows.columns)
    found = [r[0] for r in rows.select(key).collect()]
    assert sorted(found) == sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect())


@pytest.mark.parametrize("name", ["op5_substring_dedup", "op10_decontamination"])
def test_findings_name_documents(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    assert dict(rows.dtypes)["doc_id"] == "bigint" and rows.count() > 0
