import pytest

from quern.llm import oracles, queries
from tests.compare import connect, differences


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert not differences(queries.queries()[name](spark, sf_dir), connect(sf_dir), oracles.oracle_sql()[name])


def test_each_operator_has_one_query(spark, sf_dir):
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:14]] == [*[f"op{k}" for k in range(1, 14)], "pipeline"]
    assert names[14:] == ["quality_counts", "secret_base_spans", "url_rules"]  # parts of 2, 4 and 6, which have SQL
    contract = {
        "op1": "page_id url text n_chars", "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op6": "page_id host path rule verdict",
        "op4": "doc_id n_assign n_access n_hex base_sha256 spans", "op8": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op10": "doc_id held_out lang_pred score",
        "op11": "doc_id keep_id group_size kept text_sha256", "op12": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256", "op13": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    }
    for name in names:
        if (key := name.split("_")[0]) in contract:
            assert set(contract[key].split()) <= set(queries.queries()[name](spark, sf_dir).columns)
