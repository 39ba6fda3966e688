"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "riskweir", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings every operator assumes: UTC, AQE and skew handling on, ANSI left on.

    On a cluster the submit command supplies master, memory and checkpoint folder;
    nothing here overrides what is already set.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Streaming state on disk: the newest-record job holds one row per id.
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, where lineage is cut and tables are stored.

    Only a local master without that setting gets a temporary folder of its own, once per session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskweir-"))
    return spark.sparkContext.getCheckpointDir()


def use_checkpoints(spark: SparkSession) -> None:
    """Let iterative fits cut their lineage in the shared folder."""
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder path for one run's tables. All of a session's lie in one folder, which goes when the session ends."""
    root = f"{shared_dir(spark).rstrip('/')}/riskweir-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{root}/{name}-{os.urandom(6).hex()}"
