"""The registered queries of this package give the rows of their SQL, or the columns that were asked for."""

import os

import pytest

from tessera.llm import queries
from tests.compare import both

FOLDER = os.environ.get("TEST_FOLDER", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op5_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op10_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op13_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op12_conversation_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op11_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    sql = queries.oracle_sql().get(name)
    if sql is None:
        df = queries.queries()[name](spark, FOLDER)
        assert set(COLUMNS.get(name, "").split()) <= set(df.columns)
        return
    got, want = both(spark, FOLDER, queries.queries()[name], sql)
    assert got[0] == want[0] and set(COLUMNS[name].split()) <= set(got[0])
    assert got[1] == want[1]
