"""Incremental ingestion: a stream of documents is stored, chunked, embedded and indexed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from docweir import params
from docweir.operators.index import Analyzer
from docweir.sources import store


def start(
    documents: DataFrame, folder: str, checkpoint: str, embedder: Callable | None = None,
    dimension: int = params.EMBEDDING_DIM, analyzers: dict[str, Analyzer] | None = None, buckets: int = store.BUCKETS, **trigger,
):
    """Runs :func:`store.upsert` on every micro-batch of a document stream.

    A document that is delivered again, in the same batch or in any later one, replaces itself;
    one that fails is marked as failed and holds up no other.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, folder, embedder, dimension, analyzers, buckets=buckets)

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
