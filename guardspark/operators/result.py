"""The guard result struct and its builders.

``STRUCT<guard_name, passed, action, severity, message, confidence,
details STRUCT<labels ARRAY<STRING>, match_count INT>, modified_text>``.
``details`` is typed: every guard reports "a list of labels, maybe a
count"; ``DETAIL_KEYS`` names what the list and the count mean per guard.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardspark.functions import patterns as P
from guardspark.plancache import cached

DETAILS_TYPE = T.StructType(
    [
        T.StructField("labels", T.ArrayType(T.StringType()), True),
        T.StructField("match_count", T.IntegerType(), True),
    ]
)

RESULT_TYPE = T.StructType(
    [
        T.StructField("guard_name", T.StringType(), False),
        T.StructField("passed", T.BooleanType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("confidence", T.DoubleType(), False),
        T.StructField("details", DETAILS_TYPE, True),
        T.StructField("modified_text", T.StringType(), True),
    ]
)

RESULTS_TYPE = T.ArrayType(RESULT_TYPE)

# What ``labels`` / ``match_count`` stand for, per guard.
DETAIL_KEYS: dict[str, tuple[str | None, str | None]] = {
    P.PII_DETECTOR: ("detected_types", "match_count"),
    P.PROMPT_INJECTION: ("reasons", None),
    P.TOXIC_CONTENT: ("triggered_categories", "match_count"),
    P.TOPIC_RESTRICTION: ("triggered_topics", "match_count"),
    P.PII_REDACTOR: ("redacted_types", "redaction_count"),
    P.HALLUCINATION: ("indicators", None),
    P.CONTENT_FILTER: ("violations", None),
    P.OUTPUT_VALIDATOR: ("violations", None),
}


def _no_labels() -> Column:
    return F.array().cast("array<string>")


def lit(x) -> Column:
    """A literal Column, made once: the same handful of constants appear in
    every guard."""
    return cached(("lit", type(x), x), lambda: F.lit(x))


def _c(x) -> Column:
    return x if isinstance(x, Column) else lit(x)


def make(
    guard_name,
    passed,
    action,
    severity,
    message,
    confidence,
    labels=None,
    match_count=None,
    modified_text=None,
) -> Column:
    """Build one result struct from columns or Python values."""
    return F.struct(
        _c(guard_name).cast("string").alias("guard_name"),
        _c(passed).cast("boolean").alias("passed"),
        _c(action).cast("string").alias("action"),
        _c(severity).cast("string").alias("severity"),
        _c(message).cast("string").alias("message"),
        _c(confidence).cast("double").alias("confidence"),
        F.struct(
            (_no_labels() if labels is None else _c(labels)).alias("labels"),
            _c(match_count).cast("int").alias("match_count"),
        ).alias("details"),
        _c(modified_text).cast("string").alias("modified_text"),
    )


def passing(guard_name: str, message: str, confidence=0.0) -> Column:
    """A pass result: action pass, severity low, empty details."""
    return make(guard_name, True, "pass", "low", message, confidence)


def error(guard_name: str, error_type: str, error_text: str | Column) -> Column:
    """Fail-closed result for a guard that could not run on a row."""
    return make(
        guard_name,
        False,
        "block",
        "critical",
        P.MSG_GUARD_ERROR + error_type,
        1.0,
        labels=F.array(_c(error_text)),
    )


def sealed(**columns: Column) -> Column:
    """The columns as one generator of a single row, for ``select("*", ...)``.

    A filter over plain projected columns is pushed below them, with every
    expression it reads copied into it, level by level: a chain of guards would be
    copied many times over.  Nothing is pushed below a generator's output.
    """
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def join_labels(labels: Column, sep: str = ", ") -> Column:
    return F.array_join(labels, sep)


def py_list_repr(items: Column) -> Column:
    """``str(list_of_str)`` for strings without quotes or backslashes."""
    quoted = F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def flatten(r: Column, prefix: str = "") -> list[Column]:
    """Scalar columns of a result struct, for sinks and comparisons."""
    return [
        r["guard_name"].alias(prefix + "guard_name"),
        r["passed"].alias(prefix + "passed"),
        r["action"].alias(prefix + "action"),
        r["severity"].alias(prefix + "severity"),
        r["message"].alias(prefix + "message"),
        r["confidence"].alias(prefix + "confidence"),
        F.array_join(r["details"]["labels"], "|").alias(prefix + "labels"),
        r["details"]["match_count"].alias(prefix + "match_count"),
    ]


def named_details(r: Column) -> Column:
    """``details`` of one result as a JSON text under the guard's own keys
    (``DETAIL_KEYS``); a user guard's are ``labels`` and ``match_count``."""
    name, out = r["guard_name"], None
    for guard, (labels, count) in {**DETAIL_KEYS, None: ("labels", "match_count")}.items():
        fields = [r["details"]["labels"].alias(labels)]
        if count:
            fields.append(r["details"]["match_count"].alias(count))
        text = F.to_json(F.struct(*fields))
        if guard is None:
            return out.otherwise(text)
        out = F.when(name == guard, text) if out is None else out.when(name == guard, text)


def flat_struct(r: Column, pos: Column | None = None, stage: str | None = None) -> Column:
    """The flattened fields of one result as a struct (with its position)."""
    fields = [] if stage is None else [F.lit(stage).alias("stage")]
    fields += [] if pos is None else [pos.alias("pos")]
    fields += [
        r["guard_name"].alias("guard_name"),
        r["passed"].alias("passed"),
        r["action"].alias("action"),
        r["severity"].alias("severity"),
        r["message"].alias("message"),
        r["confidence"].alias("confidence"),
        F.array_join(r["details"]["labels"], "|").alias("labels"),
        r["details"]["match_count"].alias("match_count"),
    ]
    return F.struct(*fields)


def explode_flat(results: Column) -> Column:
    """One output row per result: ``pos`` and the flat fields.

    The fields are taken inside ``transform`` and emitted by ``inline``:
    reading struct fields above an ``explode`` lets the optimizer copy the
    whole results expression once per field.
    """
    return F.inline(F.transform(results, lambda r, i: flat_struct(r, i)))
