"""Every query and stage on odd and on empty tables, and the columns it must return."""

import pytest

import corpus_pipeline
from subdiv.llm.registry import QUERIES

COLUMNS = {
    "op1_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op2_decontamination": {"doc_id", "item_id", "distance"},
    "op3_ngram_join": {"doc_id", "n_shingles", "component_id"},
    "op4_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op5_quality_model": {"doc_id", "held_out", "score", "predicted"},
    "op6_license_scan": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op7_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op9_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op10_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op11_near_vectors": {"vec_id", "n_links", "component_id", "kept"},
    "op12_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    "op13_phrases": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_tables(spark, odd_dir, name):
    table = {"op1_url_filter": "pages", "op4_html_extraction": "pages", "op11_near_vectors": "embeddings"}.get(name, "documents")
    out = QUERIES[name](spark, odd_dir)
    assert COLUMNS[name] <= set(out.columns)
    rows = out.collect()
    n = spark.read.parquet(f"{odd_dir}/{table}.parquet").count()
    if name == "op2_decontamination":
        assert {(r.doc_id, r.item_id) for r in rows} == {(106, 1), (106, 3)}
    elif name == "op8_best_fit_packing":
        assert len([r for r in rows if r.piece == 0]) == n
    elif name not in ("op12_hard_negatives", "op13_phrases"):
        assert len(rows) == n
    if "score" in out.columns and name != "op13_phrases":
        assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_pipeline_on_odd_tables(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.columns == columns, name
        assert out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), out.schema)
    left = [r.doc_id for r in docs.collect()]
    assert left.count(5) == 1 and 104 not in left and 106 not in left and 100 not in left and 107 not in left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, odd_dir).collect()
    assert sum(r.piece == 0 for r in packed) == len(left)


def test_pipeline_on_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
