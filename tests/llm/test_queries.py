"""The registered queries: those with SQL against it, all of them with their contracts' columns."""

import pytest
from oracle import compare, connect

from textloom.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_packing": "doc_id chunk chunk_start n_tokens bin_id bin_size bin_offset",
    "op2_token_shards": "doc_id start n_tokens ids_crc32",
    "op3_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op4_embedding_dedup": "vec_id n_links component_id kept",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_decontamination": "doc_id n_words n_hit n_items items_sha256 longest_words longest_item_id longest_at contaminated",
    "op7_main_text": "page_id url text n_chars",
    "op8_line_dedup": "doc_id line_no kind first_doc_id first_line_no",
    "op9_ngram_jaccard": "doc_id n_shingles component_id",
    "op10_warc": "page_id payload_bytes payload_digest record_type refers_to",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf, name):
    assert compare(spark, connect(sf), QUERIES[name], ORACLE_SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split() and df.count() > 0
