"""Output guards (C5-C8): one sentence per rule."""

from conftest import guard_results

from guardspark import policy as PL
from guardspark.operators import guards as G
from guardspark.plans import chain
from pyspark.sql import functions as F


def conf(name, **kw):
    return PL.guard_conf(PL.overlay(PL.DEFAULT_POLICY, {"output_guards": {name: kw}}), name)


def test_redactor_safe_order(spark):
    g = G.PIIRedactor(conf("pii_redactor"))
    text = "Orders: desk@mill.test, phone 555-987-6543, any day."
    r = guard_results(spark, g, [text, "nothing here"])
    assert r[0].passed and r[0].action == "redact" and r[0].severity == "medium"
    assert r[0].confidence == 0.9
    assert sorted(r[0].details.labels) == ["email", "phone"]
    out = r[0].modified_text
    assert "desk@mill.test" not in out and "555-987-6543" not in out
    assert len(out) == len(text) and out.startswith("Orders: ") and out.endswith(", any day.")
    assert r[1].action == "pass" and r[1].modified_text is None


def test_redactor_yaml_order_splits_card(spark):
    order = ["email", "phone", "ssn", "credit_card", "ip_address"]
    g = G.PIIRedactor(conf("pii_redactor", redact_types=order))
    r = guard_results(spark, g, ["4111111111111111"])[0]
    assert r.modified_text == "*" * 10 + "111111"
    g2 = G.PIIRedactor(conf("pii_redactor"))
    assert guard_results(spark, g2, ["4111111111111111"])[0].modified_text == "*" * 16


def test_hallucination(spark):
    g = G.Hallucination(conf("hallucination_detector", confidence_threshold=0.45, action="warn"))
    r = guard_results(
        spark,
        g,
        [
            "Some 12% of sailors agree. Studies show as much, and according to research "
            "the tide is slower.",
            "The map (Kern et al., 1998) was published in 1997 and reprinted by the Journal of "
            "Charts.",
            "A lighthouse is a tower with a lamp.",
        ],
    )
    assert r[0].action == "warn" and r[0].severity == "medium"
    assert r[0].details.labels == ["Unattributed statistics found: 3"]
    assert not r[1].passed and r[1].details.labels == ["Unverified citations: 3"]
    assert r[2].passed


def test_content_filter(spark):
    g = G.ContentFilter(conf("content_filter", confidence_threshold=0.5))
    r = guard_results(
        spark,
        g,
        [
            "My instructions say little, and I was told to keep the initial prompt quiet.",
            "A thriller: how to kill time, or first make a bomb scene work.",
            "The harbour was calm.",
        ],
    )
    assert r[0].action == "block"
    assert r[1].severity == "high" and not r[1].passed
    assert "Toxic content (violence): 2 matches" in r[1].details.labels
    assert r[2].passed


def test_harmful_dot_stops_at_newline_only(spark):
    g = G.ContentFilter(conf("content_filter", confidence_threshold=0.3))
    r = guard_results(spark, g, ["first a\rmix", "first a\nmix"])
    assert not r[0].passed and r[1].passed


def validate(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string, output_type string, output_required array<string>")
    g = G.OutputValidator(conf("output_validator", max_output_length=1000), F.col("output_type"), F.col("output_required"))
    return [r["r"] for r in chain.apply_guard(df, "text", g).orderBy("id").collect()]


def test_validator_blank_and_length(spark):
    r = validate(spark, [(0, "", None, None), (1, "   \n\t  ", None, None), (2, "A" * 1500, None, None), (3, "fine", None, None)])
    assert [x.passed for x in r] == [False, False, False, True]
    assert r[0].details.labels == ["Output is empty or contains only whitespace"]
    assert r[2].message == "Output validation failed: Output exceeds maximum length (1500 > 1000)"
    assert r[0].confidence == 1.0 and r[0].severity == "medium" and r[0].action == "block"


def test_validator_json(spark):
    r = validate(
        spark,
        [
            (0, '{"ship": "Ada", "mast": 3}', "object", ["ship", "mast"]),
            (1, '{"ship": "Ada"}', "object", ["ship", "mast"]),
            (2, "[1, 2, 3]", "object", None),
            (3, "plain words, no JSON", "object", ["data"]),
            (4, "true", "number", None),
            (5, '{"a": 1} trailing', "object", None),
            (6, "12", "integer", None),
        ],
    )
    assert r[0].passed
    assert r[1].details.labels == ["Missing required properties: mast"]
    assert r[2].details.labels == ["Output type mismatch: expected object, got list"]
    assert r[3].details.labels == ["Output is not valid JSON"]
    assert r[4].passed  # booleans count as numbers
    assert r[5].details.labels == ["Output is not valid JSON"]
    assert r[6].passed  # unchecked type


def test_marker_gates_keep_case_and_folding(spark):
    g = G.Hallucination(conf("hallucination_detector", confidence_threshold=0.3))
    r = guard_results(spark, g, ["STUDIES SHOW it", "ſtudies show it", "nothing to see"])
    assert r[0].details.labels == ["Unattributed statistics found: 1"]
    assert r[1].details.labels == ["Unattributed statistics found: 1"]
    assert r[2].passed and r[2].confidence == 0.0
    f = G.ContentFilter(conf("content_filter", confidence_threshold=0.3))
    r2 = guard_results(spark, f, ["FIRST you MIX it", "Then connect", "mix only"])
    assert not r2[0].passed and not r2[1].passed and r2[2].passed


def test_schema_of_neither_type_nor_required_keys_asks_for_json(spark):
    rows = [(0, "no json", True), (1, "no json", False), (2, "[1, NaN]", True), (3, '{"a": -Infinity, "a": 1}', True), (4, "{'a': 1}", True)]
    df = spark.createDataFrame(
        [(i, t, None, [], g) for i, t, g in rows],
        "id long, text string, output_type string, output_required array<string>, given boolean",
    )
    g = G.OutputValidator(conf("output_validator"), F.col("output_type"), F.col("output_required"), F.col("given"))
    r = [x["r"].passed for x in chain.apply_guard(df, "text", g).orderBy("id").collect()]
    assert r == [False, True, True, True, False]


JSON_TEXTS = [
    '{"a": NaN}', "NaN", "[Infinity, -Infinity]", '{"a":1,"a":2}', '{"a":1} x', "1 2", '"s"', '  {"k": "NaN"}  ', "", "null", '{"a":01}',
    "[1,]", '{"a":+1}', "-Infinity", "{a:1}", "{'a':1}", "1.5e3", '"open', '{"a":"\n"}', ".5", "1.", '{"a":1}{"b":2}', "\xa0{}", "+Infinity",
    "INF", "[1 2]", '{"a":1}]', "1],[2", '{"x":1},"y":{"z":2}', "1,0]", '["+Infinity"]', "true", "tru", "-", "0x1", "// c\n1", '"a" "b"', "[", "{",
    '{"a":{"b":[1,{"c":NaN}]}}', '"\\u00e9"', '{"\u00e9":1}', "1e999", '{"k":1}\x00',
]


def test_json_is_read_as_python_reads_it(spark):
    import json

    from guardspark.functions import jsoncheck as J

    df = spark.createDataFrame([(t,) for t in JSON_TEXTS], "t string")
    t = F.col("t")
    for r in df.select("t", J.is_valid(t).alias("v"), J.root_type(t).alias("r"), J.object_keys(t).alias("k")).collect():
        try:
            want = json.loads(r.t)
        except ValueError:
            assert not r.v, r.t
            continue
        assert r.v and r.r == type(want).__name__, r.t
        if isinstance(want, dict):
            assert set(r.k) == set(want)
