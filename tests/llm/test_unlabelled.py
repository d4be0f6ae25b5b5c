"""The language stage of the pipeline where no label teaches a language."""

import corpus_pipeline


def test_documents_without_labels_stay(spark):
    rows = [(1, "plain words", None), (2, None, None), (3, "12 34", None), (4, "日本", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 4]
