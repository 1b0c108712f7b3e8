"""Streams with state and repeatable sinks: responses, vault, late rows."""

import datetime as dt
import time
from collections import Counter

import pytest

from guardspark.operators import vault as V
from guardspark.plans import verdict as VD
from guardspark.streaming import late as LT
from guardspark.streaming import responses as RS
from guardspark.streaming import sinks as SK
from guardspark.streaming import stream as ST

T0 = dt.datetime(2024, 1, 1)
REQ = "request_id string, ts timestamp, input_text string, process_with_llm boolean"
RESP = "request_id string, ts timestamp, output_text string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def files(spark, path, schema, *parts):
    """One file a part, in this order; a stream of one file a batch."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_responses_over_several_batches(spark, tmp_path):
    mail = "write to ada@quay.test"
    requests = files(
        spark, str(tmp_path / "req"), REQ,
        [("a", at(0), mail, True), ("b", at(1), "ask b", True), ("c", at(1), "ask c", True), ("d", at(2), "ask d", False)],
        [("e", at(12), "ask e", True), (None, at(12), "ask nobody", True), ("f", at(13), None, True)],
        [("last", at(500), "far", True)],
    )
    responses = files(
        spark, str(tmp_path / "resp"), RESP,
        [("a", at(3), "to ada@quay.test"), ("b", at(3), "one")],
        [("b", at(4), "two"), ("c", at(14), "after thirteen minutes"), ("e", at(13), "fine"), (None, at(13), "to nobody")],
        [("last", at(500), "far")],
    )
    out = RS.verdicts(requests, responses, secret="s", lateness="15 minutes")
    rows = spark.read.parquet(ST.run_available_now(out.select("request_id", "summary", "allowed", "output_text"), "resp-test")).collect()
    got = {r.request_id: r for r in rows}
    assert len(rows) == 7 and set(got) == {"a", "b", "c", "d", "e", "f", None}
    failed = "LLM generation failed: "
    assert got["b"].summary == failed + "DuplicateResponse" and not got["b"].allowed
    assert got["c"].summary == got[None].summary == failed + "ResponseMissing"
    assert got["e"].output_text == "fine" and got["d"].allowed and got["d"].output_text is None
    assert got["f"].summary == "Request validation failed: missing"
    # the same as a batch whose response table holds what came in time
    batch = VD.request_verdict(
        spark.read.parquet(str(tmp_path / "req")).where("request_id <> 'last'"),
        spark.read.parquet(str(tmp_path / "resp")).where("request_id <> 'c'"), secret="s",
    ).select("request_id", "summary", "allowed", "output_text").collect()
    assert sorted(map(str, batch)) == sorted(str(r) for r in rows if r.request_id is not None)


def test_an_open_request_waits_for_the_watermark(spark, tmp_path):
    requests = files(spark, str(tmp_path / "req"), REQ, [("a", at(0), "ask", True), ("b", at(30), "ask", True)])
    responses = files(spark, str(tmp_path / "resp"), RESP, [("x", at(30), "other")])
    out = RS.verdicts(requests, responses, secret="s")
    rows = spark.read.parquet(ST.run_available_now(out.select("request_id", "summary"), "resp-open")).collect()
    assert [r.request_id for r in rows] == ["a"]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    schema = "request_id long, text string"
    parts = [[(1, "a@b.co and 123-45-6789"), (2, None)], [(3, "c@d.co, a@b.co"), (1, "a@b.co again")], [(4, "")]]
    stream = files(spark, str(tmp_path / "texts"), schema, *parts)
    sink = SK.VaultSink(str(tmp_path / "vault"), ("ssn", "email"), "s")
    sink.run(stream)
    state = lambda: (sorted(map(str, sink.tokenized(spark).collect())), sorted(map(str, sink.vault(spark).collect())))
    first = state()
    assert len(first[0]) == 5 and len(first[1]) == 4
    # replays, in any order, whole or after one of the two tables only
    for k in (2, 0, 1, 1):
        sink.write_batch(spark.createDataFrame(parts[k], schema), k)
        assert state() == first
    sink.run(stream)  # nothing new
    assert state() == first
    texts = sink.tokenized(spark).withColumnRenamed("tokenized_text", "text")
    back = {(r.request_id, r.text) for r in V.detokenize_join(texts, sink.vault(spark)).collect()}
    assert back == {(str(i), t) for p in parts for i, t in p}


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    LT.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def test_kept_and_late_rows_are_the_input(spark, tmp_path, rocksdb):
    schema = "ts timestamp, guard_name string, action string"
    parts = [
        [(at(1), "G", "block"), (at(2), "G", "pass"), (at(7), "G", "block"), (at(30), "G", "pass")],
        [(at(3), "G", "pass"), (at(8), "H", "block"), (at(26), "G", "pass"), (at(31), "G", "block"), (None, None, "pass")],
        [(at(0), "G", "pass"), (at(59), "G", "pass")],
    ]
    stream = files(spark, str(tmp_path / "ev"), schema, *parts)
    rows = spark.read.parquet(ST.run_available_now(LT.block_rates_with_late(stream), "late-test")).collect()
    got = Counter()
    for r in rows:
        got[None if r.window_start is None else r.window_start.minute, r.guard_name, r.status] += r.n_runs * 100 + r.n_blocks
    assert got == {
        (0, "G", "closed"): 201, (5, "G", "closed"): 101, (25, "G", "closed"): 100, (30, "G", "closed"): 201,
        (0, "G", "late"): 200, (5, "H", "late"): 101, (None, "", "late"): 100,
    }
    assert sum(r.n_runs for r in rows) == sum(map(len, parts)) - 1
    # the window of 00:59 is open; all others add up, whatever the order of the files
    batch = ST.block_rates(spark.read.parquet(str(tmp_path / "ev")).where("ts < '2024-01-01 00:59:00'")).collect()
    assert sum(r.n_runs for r in rows if r.window_start) == sum(b.n_runs for b in batch)
    for b in batch:
        mine = [r for r in rows if r.window_start == b.window_start and r.guard_name == b.guard_name]
        assert (sum(r.n_runs for r in mine), sum(r.n_blocks for r in mine)) == (b.n_runs, b.n_blocks)


def test_an_empty_stream(spark, tmp_path, rocksdb):
    schema = "ts timestamp, guard_name string, action string"
    stream = files(spark, str(tmp_path / "ev"), schema, [])
    assert spark.read.schema(LT.block_rates_with_late(stream).schema).parquet(ST.run_available_now(LT.block_rates_with_late(stream), "late-empty")).count() == 0
