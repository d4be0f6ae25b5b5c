import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweir.functions import analyze
from docweir.operators import bm25, fusion, index, render, vectors

TEXTS = {
    1: ("english", "the quick brown fox jumps over the lazy dog"),
    2: ("polish", "szybki lis skacze przez psa fox"),
    3: ("english", "python web framework"),
    4: ("english", "the runners were running fast"),
}
COLUMNS = {"english": ("en", analyze.english), "polish": ("pl", analyze.simple)}


def corpus(spark, parts=4):
    rows = [(i, i, "u", lang, t, len(t.split())) for i, (lang, t) in TEXTS.items()]
    return spark.createDataFrame(
        rows, "chunk_id bigint, document_id bigint, user_id string, language string, content string, word_count int"
    ).repartition(parts)


def search(spark, en, pl, ids=None, parts=4):
    queries = spark.createDataFrame([(9, "u", en, pl, ids)], "query_id bigint, user_id string, en string, pl string, document_ids array<string>")
    chunks = corpus(spark, parts)
    posts = index.postings(chunks, {"english": analyze.english})
    terms = index.query_terms(queries, COLUMNS)
    scope = queries.select("query_id", "user_id", F.explode("document_ids").alias("d")).select("query_id", "user_id", F.col("d").cast("bigint").alias("document_id"))
    found = bm25.search_scoped(terms, scope, posts, chunks) if ids else bm25.search(terms, posts, chunks)
    return {r.chunk_id: r.score for r in found.collect()}


def test_languages_or_semantics_and_stems(spark):
    assert set(search(spark, "fox", "")) == {1}
    assert set(search(spark, "", "lis")) == {2}
    assert set(search(spark, "python database", " ")) == {3}
    assert set(search(spark, "run", "")) == {4}
    assert search(spark, "  ", "") == {}


def test_scores_follow_the_formula_for_any_partitioning(spark):
    n, avg = 4, sum(len(t.split()) for _, t in TEXTS.values()) / 4
    want = math.log((n - 1 + 0.5) / 1.5 + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 9 / avg))
    for parts in (1, 3, 16):
        assert search(spark, "fox", "", parts=parts)[1] == pytest.approx(want)


def test_document_lists_change_statistics(spark):
    want = math.log((1 - 1 + 0.5) / 1.5 + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75))
    assert search(spark, "fox", "", ["1"]) == {1: pytest.approx(want)}


def test_large_term_tables_take_the_shuffle_join(spark):
    small = search(spark, "fox dog python", "lis")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert search(spark, "fox dog python", "lis") == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_vector_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vecs, qs = rng.normal(size=(500, 8)), rng.normal(size=(7, 8))
    users = ["a" if i % 3 == 0 else "b" for i in range(500)]
    rows = spark.createDataFrame([(i, users[i], [float(x) for x in v]) for i, v in enumerate(vecs)], "chunk_id bigint, user_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, "a" if i % 2 else "b", [float(x) for x in v]) for i, v in enumerate(qs)], "query_id bigint, user_id string, embedding array<double>")
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for block in (2, 100):
        got = vectors.top_k(rows.repartition(5), queries, 10, block=block).collect()
        for i, q in enumerate(qs):
            dist = np.round(1 - unit @ (q / np.linalg.norm(q)), 9)
            mine = [j for j in np.lexsort((np.arange(500), dist)) if users[j] == ("a" if i % 2 else "b")][:10]
            assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == mine


def ranks(spark, lists):
    return spark.createDataFrame([(1, c, r) for items in lists for r, c in enumerate(items, 1)], "query_id int, chunk_id string, rank int")


def test_reciprocal_rank(spark):
    one = {r.chunk_id: r.rrf for r in fusion.reciprocal_rank(ranks(spark, ["abc"])).collect()}
    assert one == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 62), "c": pytest.approx(1 / 63)}
    two = {r.chunk_id: r.rrf for r in fusion.reciprocal_rank(ranks(spark, ["ab", "bc"])).collect()}
    assert two["b"] > two["a"] and two["b"] > two["c"]


def candidates(spark):
    rows = [(1, "c0", 1, "p1", "text zero", "P1"), (1, "c1", 2, "p1", "text one", "P1"), (1, "c2", 3, None, "text two", None)]
    schema = "query_id int, chunk_id string, rrf_rank int, parent_id string, content string, parent_content string"
    extra = {"query": F.lit("q"), "rrf": 1.0 / (60 + F.col("rrf_rank")), "document_id": F.lit("d"), "filename": F.lit("f"), "chunk_index": F.lit(0), "source_url": F.lit(None).cast("string")}
    return spark.createDataFrame(rows, schema).withColumns(extra)


def test_rerank_collapse_and_fallback(spark):
    rows = candidates(spark)
    score = F.when(F.col("chunk_id") == "c0", 0.45).when(F.col("chunk_id") == "c1", 0.95)
    ranked = fusion.rerank(rows, score)
    assert [r.chunk_id for r in ranked.orderBy("final_rank").collect()] == ["c1", "c0"]
    top = fusion.collapse(ranked).collect()
    assert [(r.chunk_content, r.score) for r in top] == [("P1", 0.95)]

    def broken(query, texts):
        raise RuntimeError("down")

    scored = rows.withColumn("m", fusion.model_score(broken)(F.col("query"), F.col("content")))
    ranked = fusion.rerank(scored, F.col("m.score"), F.col("m.failed"))
    assert [r.chunk_id for r in ranked.orderBy("final_rank").collect()] == ["c0", "c1", "c2"]
    assert [r.chunk_content for r in fusion.collapse(ranked).orderBy("rank").collect()] == ["P1", "text two"]


def test_markdown_answer(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    rows = [(1, 1, "A", "d", "f.txt", 0, 0.5, "https://x"), (1, 2, "B", "d", "g.txt", 1, 0.4, None)]
    results = spark.createDataFrame(rows, "query_id int, rank int, chunk_content string, document_id string, document_filename string, chunk_index int, score double, source_url string")
    got = {r.query_id: r.markdown for r in render.markdown_answer(queries, results).collect()}
    assert got[1] == "---\nsources:\n  - https://x\n  - g.txt\n---\n\n### Source: https://x\nA\n\n### Source: g.txt\nB\n"
    assert got[2] == "---\nsources: []\n---\n\nNo relevant documentation found."


def test_embedding_contract(spark):
    rows = spark.createDataFrame([(i, f"w{i} x") for i in range(70)], "id int, content string")
    seen = vectors.embed(rows, vectors.hashing_embedder(16), dimension=16).collect()
    assert [len(r.embedding) for r in seen] == [16] * 70
    with pytest.raises(Exception):
        vectors.embed(rows, lambda ts: [[1.0]] * len(ts), dimension=16).collect()
