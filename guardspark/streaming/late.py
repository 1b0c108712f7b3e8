"""Late rows accounted for (H2): block-rate windows that lose no row.

The engine drops rows behind the watermark silently.  Here each (window,
guard) is a key with state of its own: rows that come in time are counted, a timer
at the window's end emits the counts when the watermark passes it, and rows that come
after that are emitted as late instead of being dropped.  Kept and late rows add up to the input, in whatever order
files come.

State is two numbers a key and is cleared when the window closes; a late row needs none.  Streams
that use it need the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: ``status`` is "closed" for a window's final counts, "late" for rows behind the watermark.
LATE_SCHEMA = "window_ms long, guard_name string, status string, n_runs long, n_blocks long"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class WindowCounts(StatefulProcessor):
    """Counts of one (window, guard)."""

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "n_runs long, n_blocks long")

    def _row(self, key, status: str, runs: int, blocks: int) -> pd.DataFrame:
        return pd.DataFrame({"window_ms": [key[0]], "guard_name": [key[1]], "status": [status], "n_runs": [runs], "n_blocks": [blocks]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = blocks = 0
        for part in rows:
            runs += int(part["n_runs"].sum())
            blocks += int(part["n_blocks"].sum())
        end = int(key[0]) + self.window_ms
        if end <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, "late", runs, blocks)
            return
        if self.counts.exists():
            before = self.counts.get()
            runs, blocks = runs + before[0], blocks + before[1]
        else:
            self.handle.registerTimer(end)
        self.counts.update((runs, blocks))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, blocks = self.counts.get()
        self.counts.clear()
        yield self._row(key, "closed", runs, blocks)

    def close(self) -> None:
        pass


def block_rates_with_late(
    events: DataFrame, ts: str = "ts", window_minutes: int = 5, watermark: str = "10 minutes"
) -> DataFrame:
    """Rows (window_start, window_end, guard_name, status, n_runs, n_blocks) of a stream of guard events (ts, guard_name, action).

    A row without an event time belongs to no window: it is late at once, under a null window.
    """
    width = window_minutes * 60_000
    at = F.col(ts).cast("timestamp")
    marked = events.withColumn(ts, at).withWatermark(ts, watermark)
    # the event time goes on as a plain number: by the time column the engine would drop late rows here
    millis = F.unix_millis(F.col(ts))
    rows = marked.select(
        F.coalesce(millis - F.pmod(millis, F.lit(width)), F.lit(-width)).alias("window_ms"),
        F.coalesce("guard_name", F.lit("")).alias("guard_name"),
        F.lit(1).cast("long").alias("n_runs"),
        F.when(F.col("action") == "block", 1).otherwise(0).cast("long").alias("n_blocks"),
    )
    out = rows.groupBy("window_ms", "guard_name").transformWithStateInPandas(
        WindowCounts(width), outputStructType=LATE_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
    start = F.when(F.col("window_ms") >= 0, F.timestamp_millis("window_ms"))
    end = F.when(F.col("window_ms") >= 0, F.timestamp_millis(F.col("window_ms") + width))
    return out.select(start.alias("window_start"), end.alias("window_end"), "guard_name", "status", "n_runs", "n_blocks")
