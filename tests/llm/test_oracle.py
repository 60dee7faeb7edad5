"""Queries that have SQL against it, and what each of them returns, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from pagemart.llm.queries import ORACLES, QUERIES
from tests.test_oracle import plain

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="shared tables are not here")

COLUMNS = {
    "op1_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_winnowing": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_ngram_join": "doc_id n_shingles component_id",
    "op5_backoff_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op11_whitening": "vec_id component n deviation whitened explained identity_error",
    "op12_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op13_lexical_search": "item_id rank doc_id score",
}


#: Queries whose rows are not one per document.
OTHER_ROWS = {"op7_mixing", "op11_whitening", "op13_lexical_search"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    frame = entry.queries()[name](spark, str(DATA))
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert plain(frame.columns, frame.collect()) == plain(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_a_row_per_document(spark, duck, name):
    frame = entry.queries()[name](spark, str(DATA))
    wanted = COLUMNS.get(name, "doc_id").split()
    assert frame.columns[: len(wanted)] == wanted
    if name not in OTHER_ROWS:
        (count,) = duck.execute("SELECT count(*) FROM documents").fetchone()
        assert frame.count() == count
