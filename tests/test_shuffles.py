"""What search and indexing leave in place: plans without the shuffles that grow with all words or all pairs."""

import os
import re
from collections import Counter

import pytest

from docweir.catalog import retrieval
from docweir.functions import analyze
from docweir.operators import bm25, fusion, index
from docweir.plans import hybrid

SF = "/root/testdata/sf0.001"
SCHEMA = "chunk_id bigint, document_id bigint, user_id string, language string, content string, word_count int"


def exchanges(df):
    """What the exchanges of a plan are dealt out by."""
    return re.findall(r"Exchange (hashpartitioning\(.*?\)|rangepartitioning\(.*?\)|SinglePartition)", df._jdf.queryExecution().executedPlan().toString())


def chunks(spark):
    texts = ["b a b", "", None, "été THE the ete", "x", "the a b c"]
    return spark.createDataFrame([(i, i, "u", "pl" if i == 3 else "en", t, len((t or "").split())) for i, t in enumerate(texts)], SCHEMA)


def test_postings_are_counted_in_their_row(spark):
    for analyzers in (None, {"en": analyze.english, "pl": analyze.polish(["été"])}):
        assert exchanges(index.postings(chunks(spark), analyzers)) == []
    rows = index.postings(chunks(spark)).collect()
    got = {(r.chunk_id, r.lexeme): r.tf for r in rows}
    want = Counter((r.chunk_id, w) for r in chunks(spark).collect() for w in (r.content or "").lower().split())
    assert got == want and len(rows) == len(want)
    polish = index.postings(chunks(spark), {"pl": analyze.polish(["été"])}).where("chunk_id = 3").collect()
    assert {r.lexeme: r.tf for r in polish} == {"the": 2}


def terms(spark):
    rows = [(q, "u", lang, w) for q, words in enumerate(("a b", "the x b")) for lang in ("en", "pl") for w in words.split()]
    return spark.createDataFrame(rows, "query_id int, user_id string, language string, lexeme string")


def test_pairs_of_query_and_chunk_are_summed_where_the_chunk_lies(spark):
    scope = spark.createDataFrame([(q, "u", d) for q in (0, 1) for d in (0, 3, 5)], "query_id int, user_id string, document_id bigint")
    posts = index.postings(chunks(spark))
    found = {
        "all": bm25.search(terms(spark), posts, chunks(spark)),
        "scoped": bm25.search_scoped(terms(spark), scope, posts, chunks(spark)),
        "matched": bm25.matched_chunks(terms(spark), posts),
    }
    for name, df in found.items():
        assert not [e for e in exchanges(df) if "query_id" in e and "chunk_id" in e], name
    assert {(r.query_id, r.chunk_id) for r in found["all"].collect()} == {(0, 0), (0, 5), (1, 0), (1, 3), (1, 4), (1, 5)}
    assert {(r.query_id, r.chunk_id) for r in found["scoped"].collect()} == {(0, 0), (0, 5), (1, 0), (1, 3), (1, 5)}
    assert {(r.query_id, r.chunk_id): r.terms for r in found["matched"].collect()}[1, 5] == 2


def test_many_terms_take_the_shuffle_join(spark, monkeypatch):
    few = {(r.query_id, r.chunk_id): r.score for r in bm25.search(terms(spark), index.postings(chunks(spark)), chunks(spark), digits=9).collect()}
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 1)
    many = {(r.query_id, r.chunk_id): r.score for r in bm25.search(terms(spark), index.postings(chunks(spark)), chunks(spark), digits=9).collect()}
    assert few == many


def test_document_lists_are_never_broadcast(spark, monkeypatch):
    # a row for each query and document: stored, they are small files, in the driver's memory they are not
    scope = spark.range(6000).selectExpr("cast(id div 60 as int) as query_id", "'u' as user_id", "id % 60 as document_id")
    found = bm25.search_scoped(terms(spark), scope, index.postings(chunks(spark)), chunks(spark), digits=9)
    joins = re.findall(r"(\w+Join) \[[^\]]*document_id#[^\]]*\]", found._jdf.queryExecution().executedPlan().toString())
    assert joins and not [j for j in joins if j.startswith("Broadcast")]
    few = {(r.query_id, r.chunk_id): r.score for r in found.collect()}
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 1)
    many = bm25.search_scoped(terms(spark), scope, index.postings(chunks(spark)), chunks(spark), digits=9)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and {(r.query_id, r.chunk_id): r.score for r in many.collect()} == few and len(few) == 6


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_texts_lie_where_they_are_until_candidates_are_known(spark):
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = retrieval.hybrid_corpus(spark, SF)
        candidates = spark.createDataFrame([(1, i) for i in range(0, 60, 5)], "query_id bigint, chunk_id bigint")
        texts = held.chunks.select("chunk_id", "parent_id", "content")
        assert exchanges(texts) == []
        # only candidates' rows leave the scan: the one exchange is that of their bucket numbers
        assert [e for e in exchanges(fusion.maybe_asked(texts, candidates, "chunk_id")) if "_bucket" not in e] == []
        rows = fusion.hydrate(candidates, held.chunks, held.documents, held.parents).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.chunk_id: r.content for r in rows} == {i: want[i] for i in range(0, 60, 5)}
    assert {r.chunk_id: r.parent_content for r in rows} == {i: f"parent p{i // 4}" if i % 7 else None for i in range(0, 60, 5)}


def test_vectors_of_their_own_table_are_searched_as_those_of_the_chunks(spark):
    queries = spark.createDataFrame([(1, "u", [1.0, 0.0])], "query_id bigint, user_id string, embedding array<double>")
    vecs = spark.createDataFrame([(0, [0.0, 1.0]), (2, [1.0, 1.0]), (5, [1.0, 0.1])], "chunk_id bigint, embedding array<double>")
    apart = chunks(spark).select("chunk_id", "document_id", "user_id").join(vecs, "chunk_id")
    found = [
        hybrid.vector_branch(queries, held, 50, 6).orderBy("rank").collect()
        for held in (
            hybrid.Corpus(chunks(spark).join(vecs, "chunk_id", "left"), None, None, None),
            hybrid.Corpus(chunks(spark), None, None, None, apart),
        )
    ]
    assert found[0] == found[1] and [r.chunk_id for r in found[1]] == [5, 2, 0]
