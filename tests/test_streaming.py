"""Streaming (H1, H2): stream equals batch; watermarked block-rate windows."""

import datetime as dt

from conftest import SF_SMALL

from guardspark.plans import catalog as C
from guardspark.streaming import stream as ST
from pyspark.sql import functions as F


def test_stream_screen_equals_batch(spark):
    s = C.stream_screen(spark, SF_SMALL)
    b = C.input_only_verdict(spark, SF_SMALL)
    cols = sorted(b.columns)
    assert sorted(s.columns) == cols
    assert s.select(cols).exceptAll(b.select(cols)).count() == 0
    assert b.select(cols).exceptAll(s.select(cols)).count() == 0


def test_block_rate_stream_with_watermark(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [
        (t0 + dt.timedelta(minutes=m), g, a)
        for m, g, a in [(1, "G", "block"), (2, "G", "pass"), (7, "G", "block"), (30, "G", "pass")]
    ]
    src = tmp_path / "events"
    spark.createDataFrame(rows, "ts timestamp, guard_name string, action string").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, guard_name string, action string").parquet(str(src))
    out = ST.run_available_now(ST.block_rates(stream), "block_rate_test")
    got = {(r.window_start.minute, r.n_runs, r.n_blocks) for r in spark.read.parquet(out).collect()}
    # windows closed by the watermark (max ts 00:30 - 10 min) are emitted
    assert got == {(0, 2, 1), (5, 1, 1)}
    batch = ST.block_rates(spark.read.parquet(str(src))).collect()
    assert len(batch) == 3


def test_stream_of_a_folder_of_part_files_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    s = C.stream_screen(spark, str(tmp_path))
    b = C.input_only_verdict(spark, SF_SMALL).select(s.columns)
    assert s.count() == docs.count()
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_small_batches_read_every_file(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    stream = ST.read_table_stream(spark, str(tmp_path), "documents", docs.schema, bytes_per_batch=1000)
    out = spark.read.parquet(ST.run_available_now(stream.select("doc_id"), "small_batches"))
    assert out.count() == out.distinct().count() == docs.count()


def test_block_rate_stream_takes_an_unsorted_table_whole(spark, tmp_path, monkeypatch):
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    # parts written latest events first
    path = str(tmp_path / "events.parquet")
    first, last = events.agg(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")).first()
    part = F.floor((F.col("ts").cast("timestamp").cast("double") - first.timestamp()) / ((last - first).total_seconds() + 1) * 4)
    for k in (3, 2, 1, 0):
        events.where(part == k).coalesce(1).write.mode("append").parquet(path)
    monkeypatch.setattr(ST.read_table_stream, "__defaults__", (1000,))
    key = lambda r: (r.window_start, r.guard_name, r.n_runs, r.n_blocks)
    got = sorted(key(r) for r in C.block_rate_stream(spark, str(tmp_path)).collect())
    batch = C.block_rate_window(spark, str(tmp_path)).collect()
    closed = last.replace(tzinfo=None) - dt.timedelta(minutes=10)
    assert got and got == sorted(key(r) for r in batch if r.window_end.replace(tzinfo=None) <= closed)


def test_late_event_behind_watermark_is_dropped(spark, tmp_path):
    """Restart from the checkpoint after new input arrives: the persisted
    watermark drops a row older than the allowed lateness."""
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    schema = "ts timestamp, guard_name string, action string"
    src, ckpt, sink = tmp_path / "src", tmp_path / "ckpt", tmp_path / "sink"

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        q = (
            ST.block_rates(stream).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", str(ckpt)).option("path", str(sink))
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()

    on_time = [(t0 + dt.timedelta(minutes=m), "G", "block") for m in (1, 2, 30)]
    spark.createDataFrame(on_time, schema).coalesce(1).write.parquet(str(src / "a"))
    run()
    late = [(t0 + dt.timedelta(minutes=3), "G", "block")]  # 27 minutes late
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(str(src / "b"))
    run()
    got = {(r.window_start.minute, r.n_runs) for r in spark.read.parquet(str(sink)).collect()}
    assert got == {(0, 2)}  # the late row does not reopen the final window
