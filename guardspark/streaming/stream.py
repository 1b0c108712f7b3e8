"""Streaming screens (H1) and block-rate windows with late data (H2).

Guards are column expressions, so the batch chains run unchanged on a
streaming DataFrame.  H1 is stateless (append mode, no watermark needed):
the vault token is a keyed hash, so even tokenization carries no state.
H2 counts guard runs and blocks per event-time window and guard; the
watermark bounds the state and decides when a window is final.

Checkpoints and sink folders live under the session's shared checkpoint
root (``spark.checkpoint.dir``), so a restarted driver or a lost executor
resumes from the last committed micro-batch.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardspark.plans import verdict
from guardspark.session import checkpoint_root


def read_table_stream(
    spark: SparkSession, sf_dir: str, name: str, schema: T.StructType, bytes_per_batch: int | None = 1 << 30
) -> DataFrame:
    """A file-source stream over one table, a folder of part files or a single
    file, in micro-batches of about ``bytes_per_batch``.  Files come in the order
    of their writing: where a watermark drops late rows and event time does not
    follow that order, give None, and one micro-batch takes all files."""
    # as a pattern that only this name fits: a stream takes a plain path for a folder
    path = f"{sf_dir.rstrip('/')}/[{name[0]}]{name[1:]}.parquet"
    reader = spark.readStream.schema(schema)
    if bytes_per_batch is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


def screen_stream(stream: DataFrame, policy: dict[str, Any] | None = None) -> DataFrame:
    """H1: the input-only verdict on a streaming prompts frame."""
    return verdict.input_only_verdict(stream, policy)


def verdict_stream(
    stream: DataFrame, responses, policy: dict[str, Any] | None = None, *, secret: str
) -> DataFrame:
    """H1 in full: E4 on a streaming prompts frame.  ``responses`` is a column in
    the row, a function of the sanitized text, or a static table."""
    return verdict.request_verdict(stream, responses, policy, secret=secret)


def run_available_now(df: DataFrame, name: str, fmt: str = "parquet", mode: str = "append") -> str:
    """Run a streaming frame to completion over what is available; returns
    the sink folder.  Each call gets a fresh sink and checkpoint."""
    import uuid

    root = checkpoint_root(df.sparkSession)
    run = f"{root}/streams/{name}-{uuid.uuid4().hex[:12]}"
    query = (
        df.writeStream.format(fmt)
        .outputMode(mode)
        .option("checkpointLocation", f"{run}/_checkpoint")
        .option("path", f"{run}/data")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return f"{run}/data"


def block_rates(
    events: DataFrame,
    ts: str = "ts",
    window: str = "5 minutes",
    watermark: str | None = "10 minutes",
) -> DataFrame:
    """H2: runs and blocks per (window, guard) from guard event rows.

    ``events`` has one row per guard run with ``ts``, ``guard_name`` and
    ``action``.  On a stream the watermark drops rows later than the
    allowed lateness and closes windows; on a static frame it is a no-op.
    """
    ntz = isinstance(events.schema[ts].dataType, T.TimestampNTZType)
    if watermark and events.isStreaming:
        if ntz:
            # event time must be TIMESTAMP; NTZ -> TIMESTAMP -> NTZ round-trips
            # exactly in the session time zone (UTC in every job here)
            events = events.withColumn(ts, F.col(ts).cast("timestamp"))
        events = events.withWatermark(ts, watermark)
    out = events.groupBy(F.window(ts, window).alias("w"), "guard_name").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.sum(F.when(F.col("action") == "block", 1).otherwise(0)).alias("n_blocks"),
    )
    start, end = F.col("w.start"), F.col("w.end")
    if ntz:
        start, end = start.cast("timestamp_ntz"), end.cast("timestamp_ntz")
    return out.select(
        start.alias("window_start"),
        end.alias("window_end"),
        "guard_name",
        "n_runs",
        "n_blocks",
    )
