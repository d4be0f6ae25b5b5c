"""Session helpers: configuration, the shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own session."""
    return tune(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docweir")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans count on.

    Joins of rows with per-site or per-dialogue facts leave hot keys to AQE's skew
    split, also where the operator behind the join wants the key's partitioning.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # whole texts go to Python workers; a batch of them stays small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    return spark


def with_state_store(spark: SparkSession) -> SparkSession:
    """Keeps streaming state in RocksDB, as operators with list and map state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for local sessions without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return _local_folders[app]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    Used between the levels of bounded loops: a lost executor re-reads one level
    instead of replaying all of them, and the next join knows the level's size.
    """
    path = f"{shared_folder(df.sparkSession)}/level-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SCAN_PARTITIONS = "docweir.scanPartitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows by ``key`` over as many partitions as the session setting SCAN_PARTITIONS names.

    For machines whose whole input is one small file, which few tasks can read. Unset, as
    on clusters, the reader's split size decides and nothing is shuffled.
    """
    parts = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(parts), key) if parts else df
