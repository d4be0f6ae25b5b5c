"""The document store: documents, statuses, parents, chunks and postings as tables in hash buckets.

Postings are stored as a list in their chunk's row. Every table of a folder is partitioned by ``bucket``, a hash of the document id, so that what belongs
to one document lies in one bucket of each table. A change rewrites the buckets that hold
its documents and leaves all other files alone: the rows of these documents go, the new ones
come, whether they were there before or not. So a batch that is delivered again changes
nothing, and deleting a document reaches everything that was made from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweir import params
from docweir.operators import chunking, index, vectors
from docweir.session import cut_lineage

TABLES = ("documents", "statuses", "parents", "chunks", "postings")
BUCKETS = 64
#: Document ids that are broadcast, some 50 MB.
BROADCAST_IDS = 500_000
#: Files that a bucket may have before a change makes them one again.
FILES = 4
#: Files that a task may write at a time; with more buckets than that it sorts the rest of its rows.
OPEN_FILES = 64
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
DOCUMENT = ("document_id", "user_id", "filename", "content_type", "language", "raw_text")
STATUS = "document_id string, status string, error_message string, meta string"


def bucket_of(document_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(document_id.cast("string")), F.lit(buckets)).cast("int")


def _hadoop_path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, folder: str, table: str) -> bool:
    files, path = _hadoop_path(spark, f"{folder}/{table}")
    return files.exists(path)


def _stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Rows of a table; postings, which are stored as a list in each chunk's row, one by one."""
    rows = _stored(spark, folder, table)
    return index.each_posting(rows) if table == "postings" else rows


def _touched(ids: DataFrame, buckets: int) -> list[int]:
    """Bucket numbers of the given documents; there are at most ``buckets`` of them."""
    return [r[0] for r in ids.select(bucket_of(F.col("document_id"), buckets)).distinct().collect()]


def _files_by_bucket(spark: SparkSession, folder: str, table: str, touched: list[int]) -> dict[int, set[str]]:
    """Names of the files of the touched buckets; buckets without a folder are left out."""
    found = {}
    for number in touched:
        files, path = _hadoop_path(spark, f"{folder}/{table}/bucket={number}")
        if files.exists(path):
            found[number] = {f.getPath().getName() for f in files.listStatus(path)}
    return found


def _few(ids: DataFrame) -> bool:
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


@contextmanager
def _unsorted(spark: SparkSession) -> Iterator[None]:
    """Has Spark write rows by bucket in the order they come in, instead of sorting them by bucket first.

    A task reads a few files, each of one bucket, and keeps a file open for each of these buckets.
    """
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.set(WRITERS, before)


def replace_rows(spark: SparkSession, folder: str, table: str, ids: DataFrame, fresh: DataFrame | None, touched: list[int], buckets: int = BUCKETS) -> None:
    """Rewrites the touched buckets of a table: rows of ``ids`` go, ``fresh`` ones come.

    Spark writes the new files beside the table, which may be read meanwhile; at the end they take
    the place of the old files of their buckets, and buckets that are left without rows are
    removed. Fresh rows come bucket by bucket, as they are read from a table of the
    store, and old ones stay so; nothing is dealt out again unless there are many ids, or many files in a bucket.
    """
    before = _files_by_bucket(spark, folder, table, touched)
    rows = fresh.withColumn("bucket", bucket_of(F.col("document_id"), buckets)) if fresh is not None else None
    if before:
        few = _few(ids)
        old = _stored(spark, folder, table).where(F.col("bucket").isin(touched))
        old = old.join(F.broadcast(ids.select("document_id")) if few else ids.select("document_id"), "document_id", "left_anti")
        rows = old if rows is None else rows.unionByName(old, allowMissingColumns=True)
        if not few or max(map(len, before.values())) > FILES:
            # AQE joins these partitions; a small bucket becomes one file
            rows = rows.repartition("bucket")
    if rows is None:
        return
    if not exists(spark, folder, table):
        # a file without rows keeps the columns of a table whose documents have all gone
        spark.createDataFrame([], rows.drop("bucket").schema).coalesce(1).write.parquet(f"{folder}/{table}/bucket=-1")
    with _unsorted(spark):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/{table}")
    after = _files_by_bucket(spark, folder, table, touched)
    for number, names in before.items():
        if after.get(number) == names:
            # nothing took the place of these files, so all their rows were to go
            files, path = _hadoop_path(spark, f"{folder}/{table}/bucket={number}")
            files.delete(path, True)


def _newest(documents: DataFrame, buckets: int) -> DataFrame:
    """One row per document id, the last by ``created_at`` if there is such a column; dealt out by bucket."""
    last = [F.desc_nulls_last("created_at")] if "created_at" in documents.columns else []
    order = Window.partitionBy("bucket", "document_id").orderBy(*last, F.xxhash64(*DOCUMENT))
    dealt = documents.where(F.col("document_id").isNotNull()).withColumn("bucket", bucket_of(F.col("document_id"), buckets)).repartition("bucket")
    rows = dealt.withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    return rows.select(F.col("document_id").cast("string").alias("document_id"), *DOCUMENT[1:])


def _named(documents: DataFrame) -> DataFrame:
    return cut_lineage(documents.where(F.col("document_id").isNotNull()).select(F.col("document_id").cast("string").alias("document_id")).distinct())


def _of(spark: SparkSession, folder: str, table: str, ids: DataFrame, touched: list[int]) -> DataFrame:
    """Stored rows of the given documents. The rows are joined only if their buckets hold other documents too."""
    stored = _stored(spark, folder, table).where(F.col("bucket").isin(touched)).drop("bucket")
    if stored.select("document_id").distinct().join(ids, "document_id", "left_anti").isEmpty():
        return stored
    return stored.join(F.broadcast(ids) if _few(ids) else ids, "document_id", "left_semi")


def _set_status(spark: SparkSession, folder: str, ids: DataFrame, statuses: DataFrame, touched: list[int], buckets: int) -> None:
    replace_rows(spark, folder, "statuses", ids, statuses.select(*[x.split()[0] for x in STATUS.split(", ")]).withColumn("bucket", bucket_of(F.col("document_id"), buckets)).repartition("bucket"), touched, buckets)


def _plain_status(ids: DataFrame, status: str) -> DataFrame:
    return ids.select("document_id", F.lit(status).alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("string").alias("meta"))


def register(documents: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Stores documents as pending, without processing them."""
    spark = documents.sparkSession
    ids = _named(documents)
    touched = _touched(ids, buckets)
    if touched:
        replace_rows(spark, folder, "documents", ids, _newest(documents, buckets), touched, buckets)
        _set_status(spark, folder, ids, _plain_status(ids, "pending"), touched, buckets)


def upsert(
    documents: DataFrame, folder: str, embedder: Callable | None = None, dimension: int = params.EMBEDDING_DIM,
    analyzers: dict[str, index.Analyzer] | None = None, count: Callable[[str], int] = chunking.estimate_tokens, buckets: int = BUCKETS,
) -> None:
    """Stores, chunks, embeds and indexes documents; what is stored of the same ids is replaced.

    A document passes from ``in_progress`` to ``completed``, or to ``failed`` with the message of what went
    wrong in it, while the others go on; a failed document has no parents, chunks or
    postings. Texts are dealt out by bucket once, on their way into the store; what is made from them is
    made where they lie. Every language with an analyzer is indexed by it.
    """
    spark = documents.sparkSession
    ids = _named(documents)
    touched = _touched(ids, buckets)
    if touched:
        replace_rows(spark, folder, "documents", ids, _newest(documents, buckets), touched, buckets)
        _process(spark, folder, ids, touched, embedder, dimension, analyzers, count, buckets)


def _process(
    spark: SparkSession, folder: str, ids: DataFrame, touched: list[int], embedder: Callable | None = None, dimension: int = params.EMBEDDING_DIM,
    analyzers: dict[str, index.Analyzer] | None = None, count: Callable[[str], int] = chunking.estimate_tokens, buckets: int = BUCKETS,
) -> None:
    """Chunks, embeds and indexes stored documents.

    Parents, chunks and statuses each parse the texts; parsed ones, which hold every text twice, are not kept.
    """
    _set_status(spark, folder, ids, _plain_status(ids, "in_progress"), touched, buckets)
    parsed = chunking.parse_documents(_of(spark, folder, "documents", ids, touched), count=count).drop("raw_text")
    chunks, failed = chunking.child_rows(parsed.where("error IS NULL")), None
    if embedder is not None:
        chunks = cut_lineage(vectors.embed_or_tell(chunks, embedder, dimension=dimension))
        failed = chunks.where("embed_error IS NOT NULL").groupBy("document_id").agg(F.min("embed_error").alias("embed_error"))
        chunks = chunks.drop("embed_error").join(failed.select("document_id"), "document_id", "left_anti")
    statuses = chunking.lifecycle(parsed).drop("parents")
    parents = chunking.parent_rows(parsed.where("error IS NULL"))
    if failed is not None:
        parents = parents.join(failed.select("document_id"), "document_id", "left_anti")
        wrong = F.col("embed_error").isNotNull()
        statuses = statuses.join(failed, "document_id", "left").withColumns(
            {"status": F.when(wrong, "failed").otherwise(F.col("status")), "error_message": F.coalesce("error_message", "embed_error")}
        )
    replace_rows(spark, folder, "parents", ids, parents, touched, buckets)
    replace_rows(spark, folder, "chunks", ids, chunks, touched, buckets)
    stored = _of(spark, folder, "chunks", ids, touched)
    replace_rows(spark, folder, "postings", ids, index.posting_lists(stored, analyzers), touched, buckets)
    _set_status(spark, folder, ids, statuses, touched, buckets)


def reindex(ids: DataFrame, folder: str, buckets: int = BUCKETS, **options) -> None:
    """Processes stored documents again, by the ids given."""
    spark = ids.sparkSession
    ids = _named(ids)
    stored = read(spark, folder, "documents").where(F.col("bucket").isin(_touched(ids, buckets))).select("document_id")
    ids = cut_lineage(stored.join(ids, "document_id", "left_semi"))
    touched = _touched(ids, buckets)
    if touched:
        _process(spark, folder, ids, touched, buckets=buckets, **options)


def delete(ids: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Removes documents with all their parents, chunks and postings."""
    spark = ids.sparkSession
    ids = _named(ids)
    touched = _touched(ids, buckets)
    if touched:
        # what is made from a document goes before it, so that a delete cut short can be run again
        for table in reversed(TABLES):
            replace_rows(spark, folder, table, ids, None, touched, buckets)


def files(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """(bucket, path, changed_at, size) of a table's files."""
    return _stored(spark, folder, table).select(
        "bucket", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed_at"), F.col("_metadata.file_size").alias("size")
    ).distinct()
