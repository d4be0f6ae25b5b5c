"""Exact cosine top-k and the embedding stage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweir import params

#: Vectors of a block; one of 1024 dimensions has 4 MB.
BLOCK = 512


def cosine_distance(a: Column, b: Column) -> Column:
    """Cosine distance of two arrays as one expression, for pairs that are already rows."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    # null where a vector has no length
    return 1.0 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def check_dimension(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Keep vectors of the right length; others cannot be compared."""
    return vectors.where(F.size(column) == dimension)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.full_like(rows, np.nan), where=norm > 0)


def _blocks(rows: DataFrame, key: str, prefix: str, size: int) -> DataFrame:
    """Vectors of one user in blocks of at most ``size``: their ids and one flat array of unit vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for user, part in batch.groupby("user_id", sort=False):
                for at in range(0, len(part), size):
                    piece = part.iloc[at : at + size]
                    out.append((user, piece[key].to_numpy(), _unit(np.stack(piece["embedding"]).astype(np.float64)).ravel()))
            yield pd.DataFrame(out, columns=["user_id", f"{prefix}_ids", f"{prefix}_flat"])

    schema = T.StructType(
        [
            T.StructField("user_id", rows.schema["user_id"].dataType),
            T.StructField(f"{prefix}_ids", T.ArrayType(rows.schema[key].dataType)),
            T.StructField(f"{prefix}_flat", T.ArrayType(T.DoubleType())),
        ]
    )
    return rows.select("user_id", key, "embedding").mapInPandas(run, schema)


def _block_topk(k: int, digits: int):
    """mapInPandas body: the best k vectors of a corpus block for every query of a query block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                chunks, queries = np.asarray(row.c_ids), np.asarray(row.q_ids)
                corpus = np.asarray(row.c_flat).reshape(len(chunks), -1)
                distance = np.round(1.0 - corpus @ np.asarray(row.q_flat).reshape(len(queries), -1).T, digits)
                # a vector without length has no distance, and must not spoil the bound of the others
                distance = np.where(np.isnan(distance), np.inf, distance)
                keep = min(k, len(chunks))
                # everything not beyond the k-th best distance stays, ties included
                bound = np.partition(distance, keep - 1, axis=0)[keep - 1]
                at, query = np.nonzero((distance <= bound) & np.isfinite(distance))
                yield pd.DataFrame({"query_id": queries[query], "chunk_id": chunks[at], "distance": distance[at, query]})

    return run


def top_k(
    corpus: DataFrame, queries: DataFrame, k: int = params.RETRIEVAL_POOL, digits: int = 9, block: int = BLOCK
) -> DataFrame:
    """Exact nearest ``k`` chunks of each query among its user's vectors.

    ``corpus`` is ``(chunk_id, user_id, embedding)``, ``queries`` ``(query_id,
    user_id, embedding)``. Both are cut where they lie into blocks of one user's
    vectors; blocks meet on the user, as rows of one plan at any number of queries, and
    a matrix product leaves the best ``k`` of a corpus block for each query of a
    query block. Query blocks below the broadcast threshold leave the corpus in place; beyond it both
    sides shuffle and AQE splits users with many blocks. The best rows of
    all blocks are ranked with a group limit on both sides of their shuffle. Vectors
    without a user meet no query.
    """
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", corpus.schema["chunk_id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    usable = F.col("embedding").isNotNull() & F.col("user_id").isNotNull()
    asked = _blocks(queries.where(usable), "query_id", "q", block)
    pairs = _blocks(corpus.where(usable), "chunk_id", "c", block).join(asked, "user_id")
    found = pairs.drop("user_id").mapInPandas(_block_topk(k, digits), schema)
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return (
        found.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("similarity", 1.0 - F.col("distance"))
    )


def top_k_scoped(
    corpus: DataFrame, queries: DataFrame, scope: DataFrame, k: int = params.RETRIEVAL_POOL, digits: int = 9
) -> DataFrame:
    """As :func:`top_k` for queries bound to document lists ``scope(query_id, document_id)``.

    The lists decide which pairs exist, so pairs are joined and compared as rows.
    """
    pairs = (
        corpus.join(scope, "document_id")
        .join(queries.select("query_id", "user_id", F.col("embedding").alias("_q")), ["query_id", "user_id"])
        .select(
            "query_id", "chunk_id",
            F.round(cosine_distance(F.col("embedding"), F.col("_q")), digits).alias("distance"),
        )
    )
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return (
        pairs.where(F.col("distance").isNotNull() & ~F.isnan("distance"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("similarity", 1.0 - F.col("distance"))
    )


def hashing_embedder(dimension: int = params.EMBEDDING_DIM) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for an embedding model: signed token hashes, unit length."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension), dtype=np.float32)
        for i, t in enumerate(texts):
            for word in t.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dimension] += 1.0 if h & 0x80000000 else -1.0
            norm = np.linalg.norm(out[i])
            if norm:
                out[i] /= norm
        return out.tolist()

    return embed


def embed(
    rows: DataFrame,
    model: Callable[[list[str]], list[list[float]]],
    text_column: str = "content",
    prefix: str = params.PASSAGE_PREFIX,
    dimension: int = params.EMBEDDING_DIM,
    batch: int = params.MODEL_BATCH,
) -> DataFrame:
    """Add ``embedding``: prefixed texts go to the model in batches, order kept, answers checked."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        for i in range(0, len(texts), batch):
            part = [prefix + t for t in texts.iloc[i : i + batch]]
            answer = model(part)
            if len(answer) != len(part) or any(len(v) != dimension for v in answer):
                raise ValueError("the embedding model must return one vector of the set dimension per text")
            out.extend(answer)
        return pd.Series(out, index=texts.index)

    return rows.withColumn("embedding", run(F.col(text_column)))


def embed_or_tell(
    rows: DataFrame,
    model: Callable[[list[str]], list[list[float]]],
    text_column: str = "content",
    prefix: str = params.PASSAGE_PREFIX,
    dimension: int = params.EMBEDDING_DIM,
    batch: int = params.MODEL_BATCH,
) -> DataFrame:
    """Like :func:`embed`, but a text that the model fails on has the message in ``embed_error`` and no vector.

    A batch that fails is tried text by text, so one bad text takes no other with it.
    """

    def ask(texts: list[str]) -> list[list[float]]:
        answer = model(texts)
        if len(answer) != len(texts) or any(len(v) != dimension for v in answer):
            raise ValueError("the embedding model must return one vector of the set dimension per text")
        return answer

    def one(text: str) -> tuple[list[float] | None, str | None]:
        try:
            return ask([text])[0], None
        except Exception as e:
            return None, str(e) or type(e).__name__

    @F.pandas_udf("struct<embedding:array<float>,embed_error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        for i in range(0, len(texts), batch):
            part = [prefix + t for t in texts.iloc[i : i + batch]]
            try:
                out += [(v, None) for v in ask(part)]
            except Exception:  # told per text below
                out += map(one, part)
        return pd.DataFrame(out, columns=["embedding", "embed_error"])

    return rows.withColumn("_e", run(F.col(text_column))).select(*rows.columns, "_e.*")
