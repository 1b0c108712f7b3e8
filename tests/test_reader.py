"""Requests from JSON lines; verdicts by day; long texts; sketches and curves."""

import datetime as dt
import json
import random

from guardspark.operators import audit as A
from guardspark.operators import longtext as LONG
from guardspark.plans import verdict as VD
from guardspark.sources import reader as RD
from guardspark.streaming import sinks as SK
from guardspark.streaming import stream as ST
from pyspark.sql import functions as F

GOOD = {"request_id": "g", "input_text": "tell me", "process_with_llm": True}


def lines(**changes):
    return json.dumps(GOOD | changes)


CASES = [
    ("plain", '{"input_text": "hi"}', None, "hi", False),
    ("cut", '{"input_text": "hi"', "broken_json", None, False),
    ("words", "not json", "broken_json", None, False),
    ("empty", "", "broken_json", None, False),
    ("none", None, "broken_json", None, False),
    ("list", '["input_text"]', "not_an_object", None, False),
    ("null", "null", "not_an_object", None, False),
    ("number", lines(input_text=5), "input_text_type", None, False),
    ("null text", lines(input_text=None), "input_text_type", None, False),
    ("no text", '{"process_with_llm": 1}', None, None, True),
    ("context", lines(context=[1]), "context_type", None, False),
    ("asked", lines(process_with_llm="maybe"), "process_with_llm_type", None, False),
    ("off", lines(process_with_llm="OFF"), None, "tell me", False),
    ("schema", lines(output_schema=[]), "output_schema_type", None, False),
    ("no schema", lines(output_schema=None), None, "tell me", True),
]


def test_every_line_is_read_or_told_why_not(spark):
    df = spark.createDataFrame([(n, x) for n, x, *_ in CASES], "name string, line string")
    got = {r.name: r for r in RD.parse_requests(df).drop("context", "output_schema").collect()}
    assert len(got) == len(CASES)
    for name, _, error, text, asked in CASES:
        assert (got[name].reader_error, got[name].input_text, got[name].process_with_llm) == (error, text, asked), name
    good, broken = RD.quarantine(RD.parse_requests(df))
    assert good.count() + broken.count() == len(CASES) and broken.count() == sum(c[2] is not None for c in CASES)


SCHEMAS = [
    ({"type": "object", "required": ["a", "b"]}, "object", ["a", "b"], None),
    ({}, None, [], None),
    ({"type": ["object"]}, None, [], "unhashable type: 'list'"),
    ({"type": {"a": 1}}, None, [], "unhashable type: 'dict'"),
    ({"type": [], "required": []}, None, [], None),
    ({"type": 7, "required": None}, None, [], None),
    ({"required": "a"}, None, [], "required properties are not a list of strings"),
    ({"required": [1, "a"]}, None, None, "required properties are not a list of strings"),
]


def test_schemas_become_contracts_or_errors(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text("\n\n".join(json.dumps(GOOD | {"request_id": str(i), "output_schema": s}) for i, (s, *_) in enumerate(SCHEMAS)))
    reqs = RD.read_requests(spark, str(path))
    got = {int(r.request_id): r for r in reqs.drop("context").collect()}
    assert len(got) == len(SCHEMAS)
    for i, (_, kind, required, error) in enumerate(SCHEMAS):
        assert got[i].output_type == kind and got[i].output_error == error and got[i].output_schema_given
        assert required is None or got[i].output_required == required
    # a schema that cannot be applied ends in the guard's error, for valid JSON alone
    for answer, action in (('{"a": 1, "b": 2}', "Guard execution error: TypeError"), ("words", "Output validation failed")):
        v = {int(r.request_id): r for r in VD.request_verdict(reqs.drop("context"), lambda s, a=answer: F.lit(a), secret="s").collect()}
        assert v[2].overall_action == "block" and v[2].output_results[-1].message.startswith(action)
    assert {i for i, r in v.items() if r.allowed} == set()
    v = {int(r.request_id): r.allowed for r in VD.request_verdict(reqs.drop("context"), lambda s: F.lit('{"a": 1, "b": 2}'), secret="s").collect()}
    assert {i for i, ok in v.items() if not ok} == {2, 3, 6, 7}


def test_reader_errors_reach_the_verdict(spark):
    df = spark.createDataFrame([("a", "[]"), ("b", lines())], "name string, line string")
    reqs = RD.contract(RD.parse_requests(df)).drop("context", "output_schema")
    got = {r.name: r.summary for r in VD.input_only_verdict(reqs).collect()}
    assert got["a"] == "Request validation failed: not_an_object" and "failed" not in got["b"]


def test_a_stream_of_lines_reads_the_same(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = [x for _, x, *_ in CASES if x]
    (tmp_path / "in" / "a.json").write_text("\n".join(texts[:5]) + "\n \n")
    (tmp_path / "in" / "b.json").write_text("\n".join(texts[5:]))
    columns = ["line", "request_id", "input_text", "process_with_llm", "output_type", "output_error", "reader_error"]
    out = ST.run_available_now(RD.read_requests_stream(spark, str(tmp_path / "in"), 100).select(columns), "lines")
    batch = RD.read_requests(spark, str(tmp_path / "in")).select(columns)
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, batch.collect()))
    assert batch.count() == len(texts)


def test_a_day_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "verdicts")
    rows = [(i, f"text {i}", dt.date(2024, 1, 1 + i % 3)) for i in range(12)] + [(99, "dayless", None)]
    reqs = spark.createDataFrame(rows, "request_id long, input_text string, day date")
    v = VD.input_only_verdict(reqs).select("request_id", "day", "allowed", "input_results")
    state = lambda: sorted(map(str, SK.read_verdicts(spark, path, v.schema).select(*v.columns).collect()))
    SK.write_verdicts(v, path)
    whole = state()
    assert len(whole) == 13
    SK.write_verdicts(v, path)
    assert state() == whole
    second = dt.date(2024, 1, 2)
    SK.write_verdicts(v.where(F.col("day") == F.lit(second)), path)
    assert state() == whole
    fewer = v.where("request_id <> 1")
    SK.replace_day(fewer, path, second)
    assert state() == sorted(map(str, fewer.collect()))
    SK.replace_day(v.where("false"), path, second)
    assert state() == sorted(map(str, v.where(~F.col("day").eqNullSafe(F.lit(second))).collect()))
    SK.replace_day(v, path, second)
    assert state() == whole


def test_chunks_walk_like_one_text(spark):
    r = random.Random(2)
    parts = ["ada@quay.test", "123-45-6789", "555 123 4567", "4111 1111 1111 1111", "10.0.0.1", "word", "two words", "x 1", "1 x", "+1 (139) 555-2766", "\n", "é 12", "a@b", "a.b@c.de f"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 400))) for _ in range(30)] + ["1" * 3000, "a@b.co" * 400, "", None, "é" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string")
    want = sorted(map(str, A.pii_values(docs, "text", ["doc_id"]).collect()))
    for size in (10, 100, 1 << 20):
        got = LONG.pii_values(docs, "text", ["doc_id"], chunk_chars=size)
        assert sorted(map(str, got.collect())) == want
    cut = LONG.chunks(docs, "text", ["doc_id"], 100).where("doc_id = 3").orderBy("__row", "chunk_no").collect()
    assert "".join(x.chunk for x in cut) == 2 * texts[3] and len(cut) > 4


def test_days_of_sketches_merge(spark):
    values = spark.range(60_000).selectExpr("'email' AS pii_type", "concat('s', id % 2) AS source", "id % 5 AS day", "concat('v', id % 20011) AS value")
    state = A.pii_sketches(values)
    merged = {r.source: r for r in A.merged_sketches(state).collect()}
    once = {r.source: r for r in A.merged_sketches(A.pii_sketches(values.withColumn("day", F.lit(0)))).collect()}
    for s in ("s0", "s1"):
        assert merged[s] == once[s] and merged[s].n_matches == 30_000
        assert abs(merged[s].approx_distinct_values - 20011) <= 3 * A.MERGED_ERROR * 20011
    # a day computed again replaces its row
    again = state.where("day <> 3").unionByName(A.pii_sketches(values.where("day = 3")))
    assert {r.source: r for r in A.merged_sketches(again).collect()} == merged


def test_curve_at_every_threshold(spark):
    r = random.Random(3)
    rows = [(round(r.random(), 2), r.choice([0, 1, 1, None])) for _ in range(3000)] + [(None, 1), (0.5, 2)]
    df = spark.createDataFrame(rows, "score double, truth int")
    got = {x.threshold: x for x in A.quality_curve(df.repartition(7), "score", "truth").collect()}
    marked = [(s, t) for s, t in rows if s is not None and t in (0, 1)]
    assert set(got) == {s for s, _ in marked}
    for c, x in got.items():
        tp, n = sum(t for s, t in marked if s >= c), sum(s >= c for s, _ in marked)
        assert (x.n_flagged, x.tp, x.fp, x.fn) == (n, tp, n - tp, sum(t for _, t in marked) - tp)
        assert x.precision == tp / n and x.recall == tp / sum(t for _, t in marked)
    assert A.quality_curve(df.where("false"), "score", "truth").count() == 0
