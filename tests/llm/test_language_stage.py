"""The language stage of the pipeline where the network can't be trained."""

from __future__ import annotations

import corpus_pipeline


def test_no_row_to_learn_from(spark):
    rows = [(1, "clean words", None), (2, "日本語", None), (3, "123 ...", None), (4, "", None), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.known_language(spark, docs, "").collect()
    assert {(r.doc_id, r.lang) for r in got} == {(1, "und"), (2, "und")}
