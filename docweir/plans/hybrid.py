"""Hybrid search: keyword and vector branches, fusion, reranking, collapse."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweir import params
from docweir.operators import bm25, fusion, index, vectors


@dataclass(frozen=True)
class Corpus:
    """The tables a search reads; ``chunks`` carry ``word_count``, and ``embedding`` where there are no ``vectors``.

    Vectors that lie in a table of their own, ``(chunk_id, document_id, user_id, embedding)``, stay apart:
    joined to the chunks, they would have every text shuffled to look up the candidates'.
    """

    chunks: DataFrame
    postings: DataFrame
    documents: DataFrame
    parents: DataFrame
    vectors: DataFrame | None = None


def keyword_branch(queries: DataFrame, corpus: Corpus, columns: dict, pool: int, digits: int | None) -> DataFrame:
    terms = index.query_terms(queries, columns)
    if "document_ids" not in queries.columns:
        return bm25.search(terms, corpus.postings, corpus.chunks, pool, digits=digits)
    listed = F.size(F.coalesce("document_ids", F.array().cast("array<string>"))) > 0
    scoped = queries.where(listed)
    free = terms.join(scoped.select("query_id"), "query_id", "left_anti")
    return bm25.search(free, corpus.postings, corpus.chunks, pool, digits=digits).unionByName(
        bm25.search_scoped(terms, scope_rows(scoped, corpus), corpus.postings, corpus.chunks, pool, digits=digits)
    )


def scope_rows(queries: DataFrame, corpus: Corpus) -> DataFrame:
    """Document lists of queries as rows, in the type of the corpus."""
    return queries.select("query_id", "user_id", F.explode("document_ids").alias("document_id")).withColumn(
        "document_id", F.col("document_id").cast(corpus.chunks.schema["document_id"].dataType)
    )


def vector_branch(queries: DataFrame, corpus: Corpus, pool: int, digits: int) -> DataFrame:
    held = corpus.chunks if corpus.vectors is None else corpus.vectors
    vecs = held.where(F.col("embedding").isNotNull()).select("chunk_id", "document_id", "user_id", "embedding")
    if "document_ids" not in queries.columns:
        return vectors.top_k(vecs, queries, pool, digits)
    listed = F.size(F.coalesce("document_ids", F.array().cast("array<string>"))) > 0
    scoped = queries.where(listed)
    scope = scope_rows(scoped, corpus).select("query_id", "document_id").distinct()
    return vectors.top_k(vecs, queries.where(~listed), pool, digits).unionByName(
        vectors.top_k_scoped(vecs, scoped, scope, pool, digits)
    )


def hybrid_search(
    queries: DataFrame,
    corpus: Corpus,
    columns: dict,
    pool: int = params.RETRIEVAL_POOL,
    rerank_pool: int = params.RERANK_POOL,
    top_k: int = params.FINAL_TOP_K,
    score: Callable[[Column, Column], Column] | None = fusion.lexical_score,
    digits: int | None = None,
    vector_digits: int = 9,
) -> DataFrame:
    """Answer lists for ``queries(query_id, user_id, query, embedding, ...)``.

    ``columns`` maps document languages to (query column, analyzer). Without a
    ``score`` function candidates are cut to ``top_k`` and keep the fused order.
    Both branches end in at most ``pool`` rows per query; everything behind them
    runs on those.
    """
    keyword = keyword_branch(queries, corpus, columns, pool, digits)
    vector = vector_branch(queries, corpus, pool, vector_digits)
    candidates = fusion.cut(fusion.fuse(vector, keyword), rerank_pool if score else top_k)
    rows = fusion.hydrate(candidates, corpus.chunks, corpus.documents, corpus.parents)
    if score is None:
        ranked = rows.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("final_rank", F.col("rrf_rank"))
    else:
        scored = rows.join(queries.select("query_id", "query"), "query_id")
        ranked = fusion.rerank(scored, score(F.col("query"), F.col("content")))
    return fusion.collapse(ranked, top_k)
