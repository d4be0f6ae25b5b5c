"""Exact duplicates by a tree merge of sorted digest runs.

Every partition sorts its digests into a run in which each digest stands once. In
binomial rounds runs meet ``fan`` at a time, digest shard by digest shard, and are
merged in order; each level keeps, per digest, the row that stays and the number
of rows seen. A digest has one row per run, so a group of copies of any size
brings at most ``fan`` rows to a merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweir.llm.common import fold_ascii, row_of, stored

KEY = ["digest", "bytes", "check"]
SHARDS = 4096
RUN_SCHEMA = "digest string, bytes int, check long, keep_id long, keep_row long, copies long, shard int, run long"
_ARROW = pa.schema(
    [("digest", pa.string()), ("bytes", pa.int32()), ("check", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()),
     ("copies", pa.int64()), ("shard", pa.int32()), ("run", pa.int64())]
)


def digest_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """One stored row per document: id, row number, SHA-256, and length and second hash that verify it."""
    folded = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_of(row), fold_ascii(F.col(text)).alias("folded"))
    return stored(
        folded.select("doc_id", "row", F.sha2("folded", 256).alias("digest"), F.octet_length("folded").alias("bytes"), F.xxhash64("folded").alias("check"))
    )


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges neighbouring rows of one digest in a sorted run; the last of them stays."""
    held = None
    for batch in batches:
        # as Spark tells what may be null, so do the batches; what is held from one to the next may not differ by it
        batch = pa.RecordBatch.from_arrays(batch.columns, schema=_ARROW)
        table = pa.Table.from_batches([batch] if held is None else [held, batch])
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        new = np.zeros(table.num_rows - 1, dtype=bool)
        for name in KEY:
            column = table[name].combine_chunks()
            new |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate(([True], new)))
        last = np.append(first[1:], table.num_rows) - 1
        copies = np.add.reduceat(table["copies"].to_numpy(), first)
        merged = table.take(pa.array(last)).set_column(table.schema.get_field_index("copies"), "copies", pa.array(copies)).cast(_ARROW)
        done = merged.slice(0, merged.num_rows - 1)
        held = merged.slice(merged.num_rows - 1).combine_chunks().to_batches()[0]
        yield from done.to_batches()
    if held is not None:
        yield held


def merge_runs(digests: DataFrame, fan: int = 8) -> DataFrame:
    """One row per different text: its key, the row that stays (largest id, then smallest row number), its copies."""
    order = [*KEY, F.asc_nulls_first("keep_id"), F.desc("keep_row")]
    runs = digests.select(
        *KEY, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("copies"),
        F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(SHARDS)).cast("int").alias("shard"),
        F.spark_partition_id().cast("long").alias("run"),
    )
    left = runs.rdd.getNumPartitions()
    runs = runs.sortWithinPartitions(*order).mapInArrow(_collapse, RUN_SCHEMA)
    while left > 1:
        left = -(-left // fan)
        runs = runs.withColumn("run", F.floor(F.col("run") / fan)).repartition("shard", "run")
        runs = runs.sortWithinPartitions(*order).mapInArrow(_collapse, RUN_SCHEMA)
    return runs.drop("shard", "run")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fan: int = 8, row: str | None = None) -> DataFrame:
    """Every document with the document of equal text that stays.

    Texts are equal when identical after lower-casing A-Z; a null text is empty. The
    row of largest id stays; of rows that repeat an id, one; a null id loses to any
    other. Only texts that occur twice are joined back, so that documents without
    copies cross no join with rows. ``row`` names a column that numbers the rows, if there is one.
    """
    digests = digest_rows(docs, text, doc_id, row)
    groups = merge_runs(digests, fan).filter("copies > 1")
    keep_row = F.coalesce(F.col("keep_row"), F.col("row"))
    return digests.join(groups, KEY, "left").select(
        "doc_id", "row",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce(F.col("copies"), F.lit(1)).cast("long").alias("group_size"),
        (keep_row == F.col("row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
