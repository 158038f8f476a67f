"""Stages of the pipeline on rows without an id."""

import corpus_pipeline
from cases import edge_rows, frame


def test_exact_stage_keeps_texts_of_null_ids_once(spark, sf_dir):
    rows = edge_rows() + [(None, "some text of a null id", "en", None, -1, 7, "x", 9, "no", 1)]
    kept = corpus_pipeline.exact_copies(spark, frame(spark, rows), sf_dir).collect()
    assert sorted(r.text or "" for r in kept) == sorted({r[1] or "" for r in rows})
    assert [r.doc_id for r in kept if r.text == "some text of a null id"] == [None]
