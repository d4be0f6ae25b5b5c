"""Rows that used to be lost or changed: nulls, zero vectors, long dialogues, fences at the start."""

import pandas as pd
from pyspark.sql import functions as F

from docweir.functions import analyze, markdown
from docweir.operators import chunking, fusion, history, index, vectors
from docweir.sources import uploads
from docweir.streaming import jobs


def test_long_dialogue_is_cut_where_asked(spark):
    rows = spark.range(1500).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("message_id"), F.col("id").alias("turn"),
        F.lit(False).alias("truncated"), F.lit(False).alias("compacted"),
    )
    counts = spark.createDataFrame([(1, 700)], "conv_id int, count int")
    assert history.mark_truncated(rows, counts).where("truncated").count() == 700


def test_zero_vectors_cost_only_themselves(spark):
    rows = [(i, 1, 5, [float(i), 1.0]) for i in range(9)] + [(9, 1, 5, [0.0, 0.0])]
    corpus = spark.createDataFrame(rows, "chunk_id int, user_id int, document_id int, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(0, 1, [1.0, 1.0])], "query_id int, user_id int, embedding array<double>")
    assert vectors.top_k(corpus.drop("document_id"), queries, 20).count() == 9
    scope = spark.createDataFrame([(0, 5)], "query_id int, document_id int")
    assert vectors.top_k_scoped(corpus, queries, scope, 20).count() == 9


def test_null_language_is_indexed(spark):
    rows = [(1, 1, 1, None, 2, "red fox"), (2, 1, 1, "english", 1, "foxes"), (3, 1, 1, "polish", 1, "lis")]
    chunks = spark.createDataFrame(rows, "chunk_id int, document_id int, user_id int, language string, word_count int, content string")
    got = {(r.chunk_id, r.lexeme) for r in index.postings(chunks, {"english": analyze.simple}).collect()}
    assert got == {(1, "red"), (1, "fox"), (2, "foxes"), (3, "lis")}


def test_null_content_type(spark):
    docs = spark.createDataFrame([(1, 1, None, "# T\n\nsome text"), (2, 1, "text/plain", "plain")], "document_id int, user_id int, content_type string, raw_text string")
    assert {r.document_id for r in chunking.parse_documents(docs).collect()} == {1, 2}
    checked = uploads.check_uploads(spark.createDataFrame([(None, 3, "abc")], "content_type string, size int, text string")).first()
    assert checked.error_message == "Unsupported file type: "
    assert spark.range(1).select(uploads.route(F.lit("text/plain"), F.lit("a.pdf")).alias("r")).first().r == "plain"


def test_replacement_characters_of_the_text_stay(spark):
    rows = [(bytearray("a�b".encode()),), (bytearray("a�b".encode() + b"\xff"),), (bytearray(b"a\xffb"),)]
    got = spark.createDataFrame(rows, "c binary").select(uploads.decode_text(F.col("c")).alias("t")).collect()
    assert [r.t for r in got] == ["a�b", "a�b", "ab"]


def test_text_that_opens_with_a_fence(spark):
    text = "```js\nimport a from 'b'\n<Tab>\n```\nimport c from 'd'\n<Note>kept</Note>\n"
    got = spark.createDataFrame([(text,)], "t string").select(markdown.strip_jsx(F.col("t")).alias("t")).first().t
    assert got == "```js\nimport a from 'b'\n<Tab>\n```\nkept"


def test_null_progress_does_not_stop_a_stream():
    polls = pd.DataFrame({"seq": [1, 2], "status": ["in_progress"] * 2, "http_ok": [True] * 2, "pages_fetched": [1.0, 2.0], "pages_total": [float("nan")] * 2})
    assert jobs._advance(("pending", None, None, None, 0, 0), polls)[2:4] == (2, None)


def test_parent_and_chunk_ids_do_not_meet(spark):
    rows = [(1, 1, "12", 7, "p", "c", 0, "f", 0.5, 0.1, None), (1, 2, None, 12, None, "c", 0, "f", 0.4, 0.1, None)]
    names = "query_id int, final_rank int, parent_id string, chunk_id int, parent_content string, content string, chunk_index int, filename string, rerank_score double, rrf double, source_url string"
    ranked = spark.createDataFrame(rows, names).withColumn("document_id", F.lit(1))
    assert fusion.collapse(ranked).count() == 2
