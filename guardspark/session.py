"""Session helpers: a local session for tests and benches, table loading and
the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session setting: deal the rows of scanned tables over this many partitions.
SCAN_PARTITIONS = "guardspark.scan.partitions"


def local_session(
    cores: str | int = "*", shuffle_partitions: int = 8, scan_partitions: int | None = None
) -> SparkSession:
    """A local session configured the way the cluster jobs expect.

    AQE is on (partition coalescing, skew-join splitting); the web UI is off.
    Small ``maxPartitionBytes``: rows are long texts, so a split of a few
    tens of MB already carries thousands of regex walks per task.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("guardspark")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(16 * 1024 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GUARDSPARK_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    if scan_partitions:
        spark.conf.set(SCAN_PARTITIONS, str(scan_partitions))
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """One table.  ``partitions`` (or the session setting ``SCAN_PARTITIONS``)
    deals its rows round-robin over that many partitions: for files of a single
    row group, which one task would read and screen alone.  Unset, the scan's
    own splits are used, at every size."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = partitions or spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it, and it is read, never replaced; a
    scratch folder is made only where it is unset in a local session (tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        root = tempfile.mkdtemp(prefix="guardspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
