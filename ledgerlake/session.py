"""SparkSession helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int | None = None, app: str = "ledgerlake",
                  driver_memory: str = "16g", extra: dict | None = None) -> SparkSession:
    """Local session with AQE on and the web UI off (tests, bench).

    On a cluster the session comes from the launcher; operators never build one.
    """
    n = os.cpu_count() if cpus == "*" else int(cpus)
    parts = shuffle_partitions or max(8, 2 * n)
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str | None:
    """The shared folder for intermediate tables and stream state: `spark.checkpoint.dir`, or the
    context's checkpoint folder. None when neither is set: then plans run lazily and nothing
    intermediate is written - there is no machine-local stand-in."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def stored_once(df: DataFrame, label: str) -> DataFrame:
    """A frame that a plan reads several times, written once to the shared folder and read back; the frame itself
    where there is none. A lost executor costs a read, not the derivation; `drop_stored` cleans up."""
    spark, base = df.sparkSession, shared_dir(df.sparkSession)
    if not base:
        return df
    path = f"{_own_folder(spark, base)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete what this application has stored by `stored_once`; call it when its results are written."""
    base = shared_dir(spark)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark, base))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _own_folder(spark: SparkSession, base: str) -> str:
    return f"{base.rstrip('/')}/once-{spark.sparkContext.applicationId}"


# Settings for a large cluster (hundreds of executors, ~100 TB of ledger data). Shuffle
# parallelism is left to AQE: a high initial partition count is coalesced at runtime to
# ~256 MB partitions; skewed join partitions (a hot ledger or day) are split. Broadcasts
# are decided only at runtime from *measured* shuffle sizes (AQE threshold); the static,
# estimate-based broadcast is switched off, so nothing is broadcast on a guess.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def apply_cluster_conf(spark: SparkSession, overrides: dict | None = None) -> None:
    """Set the runtime SQL settings above on an existing session (values the launcher
    already set explicitly win only if passed in `overrides`)."""
    for k, v in {**CLUSTER_CONF, **(overrides or {})}.items():
        spark.conf.set(k, v)
