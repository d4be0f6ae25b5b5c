"""Registered queries that run Structured Streaming over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweir.catalog import dialogue  # noqa: F401  (registers the batch twin)
from docweir.catalog.inputs import derived, table
from docweir.catalog.registry import ORACLES, query
from docweir.catalog.text import _SPLIT
from docweir.session import shared_folder
from docweir.sources import store
from docweir.streaming import ingest, jobs, tokens


def _stream(spark, sf, name):
    """The table as a file stream: one file, or a folder of files. A stream takes a pattern for either, a plain path for folders only."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}[.]parquet")


@query("stream_job_state", ORACLES["job_state_last"])
def stream_job_state(spark, sf):
    """Job records by the stateful operator, one write per micro-batch, the last record per job."""
    kind = F.col("event_type")
    polls = _stream(spark, sf, "events").select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("seq"),
        F.when(kind.isin("view", "click"), "in_progress")
        .when(kind == "purchase", F.when(F.col("value") > 60, "completed").otherwise("in_progress"))
        .when(kind == "signup", "paused").alias("status"),
        (kind != "error").alias("http_ok"), F.col("value").cast("bigint").alias("pages_fetched"),
        ((F.col("value") * 2).cast("bigint") + 1).alias("pages_total"),
    )
    base = f"{shared_folder(spark)}/job-states-{uuid.uuid4()}"

    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    run = (
        jobs.job_state_stream(polls)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    states = spark.read.parquet(f"{base}/out")
    return states.groupBy("job_id").agg(F.max_by(F.struct("status", "error_message", "pages_fetched", "pages_total", "polls"), "batch").alias("s")).select("job_id", "s.*")


@query(
    "stream_ingest",
    f"""WITH RECURSIVE {_SPLIT}, pieces2 AS MATERIALIZED (SELECT doc_id, idx, len(regexp_extract_all('Document doc ' || doc_id || ' txt ' || piece, '[\\p{{L}}\\p{{N}}]+')) AS n FROM char_split)
    SELECT doc_id::VARCHAR AS document_id, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS tokens FROM pieces2 GROUP BY 1""",
)
def stream_ingest(spark, sf):
    """Documents arriving as a stream, chunked and indexed batch by batch."""
    docs = _stream(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("user_id"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("content_type"), F.col("lang").alias("language"), F.col("text").alias("raw_text"),
    )
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4()}"
    ingest.start(docs, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return store.read(spark, f"{base}/out", "postings").groupBy("document_id").agg(
        F.count_distinct("chunk_id").alias("chunks"), F.sum("tf").alias("tokens")
    )


def _collected(rows, base):
    """Runs a stream to the end of its input; its output by micro-batch, so that a replay writes over itself."""
    run = (
        rows.writeStream.outputMode("append")
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out/batch={i}"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return rows.sparkSession.read.parquet(f"{base}/out").drop("batch")


@query("stream_token_assembly", ORACLES["token_assembly"])
def stream_token_assembly(spark, sf):
    """Answers put together from events that arrive in five shuffled micro-batches."""
    base = f"{shared_folder(spark)}/answers-{uuid.uuid4()}"
    counted = F.sum(F.when(F.col("type") == "token", 1).otherwise(0)).over(Window.partitionBy("conv_id", "turn"))
    events = derived(spark, sf, "token_events").withColumn("_n", counted)
    closing = F.col("type").isin("done", "error")
    events = events.withColumn("seq", F.when(closing, F.col("_n")).otherwise(F.col("seq"))).drop("_n")
    events = events.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") % 60))
    events.repartition(5, F.xxhash64("conv_id", "turn", "seq", "type")).write.parquet(f"{base}/in")
    # the clock moves on once everything has arrived, which ends the stopped answers
    tick = events.limit(1).withColumns({"type": F.lit("tick"), "at": F.timestamp_seconds(F.lit(1_700_100_000))})
    tick.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return _collected(tokens.assemble_stream(stream, ["conv_id", "turn"]), base)


@query(
    "stream_record_expiry",
    """WITH u AS (SELECT user_id, ts::TIMESTAMP AS ts, CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'in_progress' END AS status FROM events),
    w AS (SELECT *, ts + to_seconds(CASE WHEN status = 'completed' THEN 3600 ELSE 600 END) AS forgotten_at,
        coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, status), (SELECT max(ts) FROM u)) AS upto FROM u)
    SELECT user_id AS job_id, status, epoch_us(forgotten_at) AS forgotten_us FROM w WHERE forgotten_at <= upto""",
)
def stream_record_expiry(spark, sf):
    """Job records that expire while events come in, a stretch of time per micro-batch."""
    base = f"{shared_folder(spark)}/records-{uuid.uuid4()}"
    updates = table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "purchase", "completed").otherwise("in_progress").alias("status"), F.col("ts").cast("timestamp").alias("at")
    )
    # files are read by age: each is written after those of earlier times
    bounds = updates.agg(F.min("at"), F.max("at")).first()
    parts, span = 4, (bounds[1] - bounds[0]) / 4
    for i in range(parts):
        part = updates.where(F.col("at") >= F.lit(bounds[0] + i * span)) if i else updates
        part = part.where(F.col("at") < F.lit(bounds[0] + (i + 1) * span)) if i < parts - 1 else part
        # one file each, while the table is read by many tasks
        part.repartition(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return _collected(jobs.forgotten_stream(stream), base).select("job_id", "status", F.unix_micros("forgotten_at").alias("forgotten_us"))
