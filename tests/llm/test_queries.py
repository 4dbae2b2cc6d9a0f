"""The registered queries: those with SQL against DuckDB, as the driver
compares; the others for their columns and rows."""

import __spark_entry__ as entry
from oracle_check import check
from quarry.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op4_decontamination": ["doc_id", "item_id", "start_pos", "end_pos", "edits"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
    "op8_quality_votes": ["doc_id", "held_out", "score", "predicted"],
    "op9_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"],
    "op10_main_text": ["page_id", "url", "text", "n_chars"],
    "op12_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}
#: Tables other than documents, and rows for each of theirs.
TABLES = {"op10_main_text": ("pages", 1), "op12_whitening": ("embeddings", 4)}


def test_sql_agrees(spark):
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert check(spark, list(ORACLES), SF, verbose=False) == {n: True for n in ORACLES}


def test_others_return_their_columns_for_every_row(spark):
    assert set(QUERIES) - set(ORACLES) == set(COLUMNS)
    for name, columns in COLUMNS.items():
        out = QUERIES[name](spark, SF)
        assert out.columns == columns, name
        if name != "op4_decontamination":
            source, each = TABLES.get(name, ("documents", 1))
            assert out.count() == each * spark.read.parquet(f"{SF}/{source}.parquet").count(), name
