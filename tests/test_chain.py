"""Chains (E1-E3, E6): order, short-circuit, disabled guards, errors."""

from conftest import texts_df

from guardspark.plans import chain, custom
from pyspark.sql import functions as F


def run(spark, guards, texts, final=False):
    df = chain.run_chain(texts_df(spark, texts), "text", guards, "res", "final" if final else None)
    return df.orderBy("id").collect()


def passing(name="PassingGuard", enabled=True):
    g = custom.column_guard(name, lambda t: F.lit(False))
    g.enabled = enabled
    return g


def blocking(name="BlockingGuard"):
    return custom.column_guard(name, lambda t: F.lit(True), "block", "Test block")


def test_all_pass(spark):
    r = run(spark, [passing(), passing("P2")], ["clean text"])[0]
    assert len(r.res) == 2 and all(x.passed for x in r.res)


def test_short_circuit_on_block(spark):
    r = run(spark, [passing(), blocking(), passing("P3")], ["test text"])[0]
    assert len(r.res) == 2 and r.res[-1].action == "block"


def test_disabled_guard_dropped(spark):
    guards = [g for g in [passing(enabled=False), passing("P2")] if g.enabled]
    assert len(run(spark, guards, ["x"])[0].res) == 1


def test_guard_error_fails_closed(spark):
    g = custom.PythonGuard("ErrorGuard", custom.raising())
    r = run(spark, [g, passing()], ["test text"])[0]
    assert len(r.res) == 1
    e = r.res[0]
    assert e.action == "block" and not e.passed and e.severity == "critical"
    assert e.message == "Guard execution error: RuntimeError" and e.confidence == 1.0


def test_redaction_chains(spark):
    red = custom.PythonGuard(
        "RedactingGuard",
        lambda t: {"passed": [True] * len(t), "action": "redact", "modified_text": t.str.replace("secret", "******")},
    )
    r = run(spark, [red, passing()], ["my secret data"], final=True)[0]
    assert len(r.res) == 2 and r.final == "my ****** data"
    r2 = run(spark, [blocking(), red], ["test secret text"], final=True)[0]
    assert len(r2.res) == 1 and r2.final == "test secret text"  # nothing after a block is applied
    r3 = run(spark, [red, blocking(), red], ["a secret, a secret"], final=True)[0]
    assert len(r3.res) == 2 and r3.final == "a ******, a ******"


def test_null_text_is_error(spark):
    df = spark.createDataFrame([(0, None)], "id long, text string")
    r = chain.input_chain(df, "text").collect()[0]
    assert len(r.input_results) == 1
    assert r.input_results[0].message == "Guard execution error: TypeError"


def test_input_order(spark):
    df = texts_df(spark, ["hello"])
    r = chain.input_chain(df, "text").collect()[0]
    assert [x.guard_name for x in r.input_results] == [
        "PIIDetectorGuard", "PromptInjectionGuard", "ToxicContentGuard", "TopicRestrictionGuard"
    ]


def test_null_condition_blocks(spark):
    g = custom.column_guard("MaybeGuard", lambda t: F.when(t == "known", F.lit(False)))
    r = run(spark, [g, passing()], ["known", "other"])
    assert [x.res[0].action for x in r] == ["pass", "block"]
    assert r[1].res[0].message == "Guard execution error: UndecidedCondition" and len(r[1].res) == 1


def test_only_the_row_that_raises_fails(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return {"passed": [True] * len(texts), "message": "fine"}

    r = run(spark, [custom.PythonGuard("PickyGuard", picky)], ["a", "bad", "b"])
    assert [x.res[0].action for x in r] == ["pass", "block", "pass"]


def test_later_guards_do_not_work_on_blocked_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(texts):
        seen.add(int(texts.notna().sum()))
        return {"passed": [True] * len(texts)}

    first = custom.column_guard("EvenGuard", lambda t: F.length(t) % 2 == 0)
    guards = [first, custom.PythonGuard("CountGuard", count)]
    chain.run_chain(texts_df(spark, ["ab", "abc", "abcd", "abcde"]), "text", guards, "res").collect()
    assert seen.value == 2


def test_guards_of_long_equal_beginnings_keep_apart(spark):
    names = ["AVeryLongGuardNameOne", "AVeryLongGuardNameTwo"]
    r = run(spark, [passing(names[0]), passing(names[1])], ["x"])[0]
    assert [x.guard_name for x in r.res] == names
