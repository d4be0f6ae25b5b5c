"""BM25 over postings, for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweir import params
from docweir.operators import index
from docweir.session import cut_lineage


def idf(n_chunks: Column, doc_freq: Column) -> Column:
    df = F.coalesce(doc_freq.cast("double"), F.lit(0.0))
    return F.ln((n_chunks - df + 0.5) / (df + 0.5) + 1)


def weight(tf: Column, words: Column, avg: Column, k1: float = params.BM25_K1, b: float = params.BM25_B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1.0 - b + b * words / avg))


KEY = ["user_id", "language", "lexeme"]


#: Rows of a term table that are broadcast, some 100 MB.
BROADCAST_TERMS = 1_000_000


def _sent(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Broadcasts ``rows``, of which there are no more than terms, while these are few; else they are never broadcast."""
    return F.broadcast(rows) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else _dealt(rows)


def _dealt(rows: DataFrame) -> DataFrame:
    """Has a join shuffle ``rows``: by the size of its files, a stored table of ids counts as small however many rows it has."""
    return rows.hint("merge")


def asked_postings(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of lexemes that some query asks for; the others never reach a join or a fold."""
    return postings.join(_sent(terms.select(*KEY).distinct(), terms), KEY, "left_semi")


def term_idf(terms: DataFrame, postings: DataFrame, stats: DataFrame) -> DataFrame:
    """Query terms with their document frequency and IDF within the user's chunks.

    Frequencies are per language, chunk counts over all of a user's languages.
    Postings hold one row per chunk and lexeme, so a row count is a chunk count,
    and it is taken only for lexemes some query asks for.
    """
    return weighed_terms(terms, asked_postings(terms, postings), stats)


def weighed_terms(terms: DataFrame, asked: DataFrame, stats: DataFrame) -> DataFrame:
    """:func:`term_idf` from postings that hold asked lexemes only."""
    freq = asked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("doc_freq"))
    return (
        terms.join(freq, KEY, "left")
        .join(stats, "user_id")
        .select(
            *terms.columns,
            F.coalesce("doc_freq", F.lit(0).cast("bigint")).alias("doc_freq"),
            idf(F.col("n_chunks"), F.col("doc_freq")).alias("idf"),
            "avg_words",
        )
    )


def matched_chunks(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """``(query_id, language, chunk_id, terms)``: how many terms of a query each chunk holds.

    As in :func:`search`, asked postings are dealt out by chunk, and counted there.
    """
    terms = cut_lineage(terms)
    asked = asked_postings(terms, postings).select(*KEY, "chunk_id").repartition("chunk_id")
    return asked.join(_sent(terms, terms), KEY).groupBy("query_id", "language", "chunk_id").agg(F.count(F.lit(1)).alias("terms"))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Best ``k`` rows per query; the group limit runs on both sides of the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(
    terms: DataFrame,
    postings: DataFrame,
    chunks: DataFrame,
    k: int = params.RETRIEVAL_POOL,
    k1: float = params.BM25_K1,
    b: float = params.BM25_B,
    digits: int | None = None,
) -> DataFrame:
    """Top ``k`` chunks per query over all of the user's documents.

    Terms meet postings on (user, language, lexeme), so chunks match on any term
    and only against terms of their own language. Postings of asked lexemes are stored, counted
    and scored from there. They are dealt out by chunk before the terms are broadcast to
    them, so that a chunk's scores are summed, and the best of a partition found, before anything
    is shuffled by query. Term tables beyond BROADCAST_TERMS rows take the shuffle join.
    """
    terms = cut_lineage(terms)
    asked = cut_lineage(asked_postings(terms, postings).select(*KEY, "chunk_id", "document_id", "tf", "word_count"))
    weighed = weighed_terms(terms, asked, index.corpus_stats(chunks))
    hits = asked.repartition("chunk_id").join(_sent(weighed, terms), KEY)
    part = F.col("idf") * weight(F.col("tf").cast("double"), F.col("word_count"), F.col("avg_words"), k1, b)
    total = F.sum(part)
    scored = hits.groupBy("query_id", "chunk_id", "document_id").agg(
        (total if digits is None else F.round(total, digits)).alias("score")
    )
    return top_k(scored, k)


def search_scoped(
    terms: DataFrame,
    scope: DataFrame,
    postings: DataFrame,
    chunks: DataFrame,
    k: int = params.RETRIEVAL_POOL,
    k1: float = params.BM25_K1,
    b: float = params.BM25_B,
    digits: int | None = None,
) -> DataFrame:
    """As :func:`search`, for queries bound to documents: ``scope(query_id, user_id, document_id)``.

    Statistics then belong to the query: chunk count, mean length and document
    frequency all run over its documents only. Postings of asked lexemes in listed documents are stored;
    they meet the lists document by document and the terms in the same
    partition, once to count and once to score, so hits are neither stored nor shuffled. Lengths are
    summed per document before they meet the lists. Lists hold a row for each query and document: they are
    stored by document and never broadcast.
    """
    terms = cut_lineage(terms)
    lists = cut_lineage(scope.select("query_id", "user_id", "document_id").repartition("user_id", "document_id").distinct())
    lengths = chunks.groupBy("user_id", "document_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("word_count").cast("double")).alias("_words"), F.count("word_count").alias("_counted")
    )
    mean = F.try_divide(F.sum("_words"), F.sum("_counted"))
    stats = _dealt(lists).join(lengths, ["user_id", "document_id"]).groupBy("query_id", "user_id").agg(
        F.sum("_n").cast("double").alias("n_chunks"), index.mean_or_one(mean).alias("avg_words")
    )
    listed = lists.select("user_id", "document_id").distinct()
    asked = asked_postings(terms, postings).join(_sent(listed, listed), ["user_id", "document_id"], "left_semi")
    asked = cut_lineage(asked.select(*KEY, "chunk_id", "document_id", "tf", "word_count"))
    placed = asked.repartition("user_id", "document_id").join(_dealt(lists), ["user_id", "document_id"])
    freq = placed.join(_sent(terms, terms), ["query_id", *KEY]).groupBy("query_id", *KEY).agg(F.count(F.lit(1)).alias("doc_freq"))
    weighed = freq.join(stats, ["query_id", "user_id"]).select(
        "query_id", *KEY, "avg_words", idf(F.col("n_chunks"), F.col("doc_freq")).alias("idf")
    )
    part = F.col("idf") * weight(F.col("tf").cast("double"), F.col("word_count"), F.col("avg_words"), k1, b)
    total = F.sum(part)
    scored = (
        placed.join(_sent(weighed, terms), ["query_id", *KEY])
        .groupBy("query_id", "user_id", "chunk_id", "document_id")
        .agg((total if digits is None else F.round(total, digits)).alias("score"))
        .drop("user_id")
    )
    return top_k(scored, k)
