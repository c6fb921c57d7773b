import pytest

from tarn.llm.entries import QUERIES, SQL
from tests.conftest import DATA
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, name, QUERIES[name], SQL[name], "sf0.01") > 0


#: The columns and types that each query has at least.
COLUMNS = {
    "op1_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op2_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op10_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op13_spelling_variants": "word string, n bigint, n_near bigint, form string, form_n bigint, root string",
    "op12_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, chars_in_limit bigint",
    "op11_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_have_their_types(spark, name):
    types = dict(QUERIES[name](spark, f"{DATA}/sf0.001").dtypes)
    assert {c: types.get(c) for c, _ in (x.split() for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
