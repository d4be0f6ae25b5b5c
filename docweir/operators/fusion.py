"""Rank fusion, candidate cut, reranking, parent collapse and the final answer list.

All rows here are bounded by two candidate pools per query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir import params
from docweir.functions import analyze
from docweir.session import cut_lineage


def reciprocal_rank(lists: DataFrame, k: int = params.RRF_K) -> DataFrame:
    """Fuse any number of rank lists ``(query_id, chunk_id, rank)``: sum of 1 / (k + rank)."""
    return lists.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def fuse(vector: DataFrame, keyword: DataFrame, k: int = params.RRF_K) -> DataFrame:
    """Fuse the two branches and keep both ranks for ties and diagnostics."""
    lists = vector.select("query_id", "chunk_id", "rank", F.lit("v").alias("src")).unionByName(
        keyword.select("query_id", "chunk_id", "rank", F.lit("b").alias("src"))
    )
    rank_of = lambda s: F.max(F.when(F.col("src") == s, F.col("rank")))
    return (
        lists.groupBy("query_id", "chunk_id")
        .agg(rank_of("v").alias("vector_rank"), rank_of("b").alias("bm25_rank"))
        .withColumn(
            "rrf",
            F.coalesce(1.0 / (k + F.col("vector_rank")), F.lit(0.0))
            + F.coalesce(1.0 / (k + F.col("bm25_rank")), F.lit(0.0)),
        )
    )


def cut(fused: DataFrame, limit: int = params.RERANK_POOL) -> DataFrame:
    """Best ``limit`` candidates; ties follow the vector order, then the keyword order."""
    w = Window.partitionBy("query_id").orderBy(
        F.desc("rrf"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"), F.col("chunk_id")
    )
    return fused.withColumn("rrf_rank", F.row_number().over(w)).where(F.col("rrf_rank") <= limit)


def maybe_asked(rows: DataFrame, asked: DataFrame, key: str, buckets: int = 1 << 18) -> DataFrame:
    """Rows whose ``key`` may be among ``asked``: its hash bucket is one of theirs.

    At most ``buckets`` bucket numbers are broadcast at any number of candidates, so
    texts are dropped where they are scanned, before the exact join shuffles the few that are left.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket")
    wanted = asked.where(F.col(key).isNotNull()).select(bucket).distinct()
    return rows.withColumn("_bucket", bucket).join(F.broadcast(wanted), "_bucket", "left_semi").drop("_bucket")


def hydrate(candidates: DataFrame, chunks: DataFrame, documents: DataFrame, parents: DataFrame) -> DataFrame:
    """Attach chunk, document and parent columns to the candidates; texts of others are not moved.

    The candidates, a pool of rows per query, are stored, as the filter and the join both read them.
    """
    candidates = cut_lineage(candidates)
    texts = chunks.select("chunk_id", "document_id", "parent_id", "chunk_index", "content")
    found = cut_lineage(candidates.join(maybe_asked(texts, candidates, "chunk_id"), "chunk_id"))
    sources = maybe_asked(documents.select("document_id", "filename", "source_url"), found, "document_id")
    above = maybe_asked(parents.select("parent_id", F.col("content").alias("parent_content")), found, "parent_id")
    return found.join(sources, "document_id").join(above, "parent_id", "left")


def lexical_score(query: Column, content: Column) -> Column:
    """Share of the query's tokens that the text holds; the default reranker."""
    q = F.array_distinct(analyze.tokens(query))
    shared = F.array_intersect(q, analyze.tokens(content))
    return F.when(F.size(q) > 0, F.size(shared) / F.size(q)).otherwise(F.lit(0.0))


def model_score(scorer: Callable[[str, list[str]], list[tuple[int, float]]], batch: int = params.MODEL_BATCH):
    """Wrap a scorer of (query, texts) -> (index, score) pairs as a column function.

    Texts of one query go in batches; texts the scorer leaves out get no score,
    and a failing call marks its rows.
    """

    @F.pandas_udf("struct<score:double,failed:boolean>")
    def run(queries: pd.Series, texts: pd.Series) -> pd.DataFrame:
        score, failed = np.full(len(texts), np.nan), np.zeros(len(texts), dtype=bool)
        for query, at in queries.groupby(queries).indices.items():
            for part in np.split(at, range(batch, len(at), batch)):
                try:
                    for j, s in scorer(query, texts.iloc[part].tolist()):
                        score[part[j]] = float(s)
                except Exception:  # the query falls back to its fused order
                    failed[part] = True
        return pd.DataFrame({"score": pd.Series(score).astype(object).where(~np.isnan(score), None), "failed": failed})

    return run


def rerank(candidates: DataFrame, score: Column, failed: Column | None = None) -> DataFrame:
    """Order candidates by ``score``; unscored ones drop out, failed queries keep the fused order."""
    scored = candidates.withColumn("_s", score).withColumn("_f", F.lit(False) if failed is None else failed)
    query = Window.partitionBy("query_id")
    marked = scored.withColumn("_failed", F.bool_or("_f").over(query))
    kept = marked.where(F.col("_failed") | F.col("_s").isNotNull())
    final = F.when(F.col("_failed"), F.lit(None).cast("double")).otherwise(F.col("_s"))
    order = query.orderBy(F.desc_nulls_last("rerank_score"), F.col("rrf_rank"))
    return (
        kept.withColumn("rerank_score", final)
        .withColumn("final_rank", F.row_number().over(order))
        .drop("_s", "_f", "_failed")
    )


def collapse(ranked: DataFrame, top_k: int = params.FINAL_TOP_K) -> DataFrame:
    """One result per parent, in rank order, with the parent's text; chunks without one stay."""
    group = Window.partitionBy("query_id", F.struct("parent_id", F.when(F.col("parent_id").isNull(), F.col("chunk_id")).alias("own"))).orderBy("final_rank")
    order = Window.partitionBy("query_id").orderBy("final_rank")
    return (
        ranked.withColumn("_nth", F.row_number().over(group))
        .where(F.col("_nth") == 1)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
        .select(
            "query_id",
            "rank",
            F.coalesce("parent_content", "content").alias("chunk_content"),
            "document_id",
            F.col("filename").alias("document_filename"),
            "chunk_index",
            F.coalesce("rerank_score", "rrf", F.lit(0.0)).alias("score"),
            "source_url",
        )
    )
