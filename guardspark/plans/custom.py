"""User guards (E6): the extension surface.

A guard is anything with ``name``, ``key``, ``enabled``, ``stages`` and
``score`` (see ``operators.guards.Guard``).  Built-in guards are column
expressions, and ``column_guard`` makes one from a boolean expression.  When a
rule cannot be written with Spark functions, ``PythonGuard`` runs a Python
function inside an Arrow-batched pandas UDF: the function takes a whole Series
of texts and returns one column per result field.  If a batch raises, its rows
are tried one by one, and a row that raises gets the fail-closed result (the
job never fails on it).

A condition that comes out null cannot decide, and blocks.  Conditions run
under ANSI rules: use the ``try_*`` functions where an expression may raise.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardspark.functions import patterns as P
from guardspark.operators import guards as G
from guardspark.operators import result as R

_FLAT = T.StructType(
    [
        T.StructField("passed", T.BooleanType()),
        T.StructField("action", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("match_count", T.IntegerType()),
        T.StructField("modified_text", T.StringType()),
    ]
)

_DEFAULTS: dict[str, Any] = {
    "action": "pass",
    "severity": "low",
    "message": "",
    "confidence": 0.0,
    "labels": [],
    "match_count": None,
    "modified_text": None,
}


def _frame(out: dict[str, Any], n: int) -> pd.DataFrame:
    """Result columns of ``n`` rows: Series, lists or single values."""
    cols = {}
    for f in _FLAT.fields:
        v = out.get(f.name, _DEFAULTS.get(f.name))
        if isinstance(v, pd.Series):
            v = v.tolist()
        elif f.name == "labels" and not (v and isinstance(v[0], list | tuple)) or not isinstance(v, list | tuple):
            v = [v] * n
        cols[f.name] = v
    cols["passed"] = [bool(x) for x in cols["passed"]]
    cols["match_count"] = pd.array([None if pd.isna(x) else int(x) for x in cols["match_count"]], dtype="Int32")
    return pd.DataFrame(cols, columns=[f.name for f in _FLAT.fields])


def _guarded(fn: Callable[[pd.Series], dict[str, Any]]) -> Callable[[pd.Series], pd.DataFrame]:
    """``fn`` on a batch; row by row only if the batch raised."""

    def run(texts: pd.Series) -> pd.DataFrame:
        try:
            return _frame(fn(texts), len(texts))
        except Exception as e:
            if len(texts) > 1:
                return pd.concat([run(texts.iloc[i : i + 1]) for i in range(len(texts))], ignore_index=True)
            # fail closed, for this row alone
            failed = {
                "passed": False,
                "action": "block",
                "severity": "critical",
                "message": P.MSG_GUARD_ERROR + type(e).__name__,
                "confidence": 1.0,
                "labels": [str(e)],
            }
            return _frame(failed, len(texts))

    return run


class PythonGuard(G.Guard):
    """Wrap ``evaluate(texts: Series) -> dict`` of result columns (keys as in the
    result struct; a Series, a list or one value for all rows)."""

    def __init__(
        self, name: str, evaluate: Callable[[pd.Series], dict[str, Any]], conf: dict | None = None
    ):
        super().__init__(conf or {})
        self.name = name
        self.key = "py" + "".join(ch for ch in name.lower() if ch.isalnum())
        guarded = _guarded(evaluate)

        @F.pandas_udf(_FLAT)
        def run(texts: pd.Series) -> pd.DataFrame:
            return guarded(texts)

        # so that the optimizer never copies the call to where its fields are read
        self._udf = run.asNondeterministic()

    def stages(self, text, fact):
        return [{"res": self._udf(text)}]

    def modified_text(self, fact):
        return fact("res")["modified_text"]

    def score(self, text, fact):
        r = fact("res")
        return R.make(
            self.name,
            r["passed"],
            r["action"],
            r["severity"],
            r["message"],
            r["confidence"],
            F.coalesce(r["labels"], F.array().cast("array<string>")),
            r["match_count"],
            r["modified_text"],
        )


def word_redactor(word: str) -> Callable[[pd.Series], dict[str, Any]]:
    """Example user rule: mask every occurrence of ``word``."""

    def evaluate(texts: pd.Series) -> dict[str, Any]:
        n = texts.map(lambda t: t.count(word))
        hit = n > 0
        return {
            "passed": [True] * len(texts),
            "action": hit.map({True: "redact", False: "pass"}),
            "severity": hit.map({True: "medium", False: "low"}),
            "message": hit.map({True: f"Redacted word: {word}", False: "Word not found"}),
            "confidence": hit.map({True: 1.0, False: 0.0}),
            "labels": hit.map(lambda h: [word] if h else []),
            "match_count": n.where(hit),
            "modified_text": texts.str.replace(word, "*" * len(word), regex=False).where(hit, None),
        }

    return evaluate


def WordRedactGuard(word: str) -> PythonGuard:  # noqa: N802 - reads as a class
    return PythonGuard("WordRedactGuard", word_redactor(word))


def raising(exc: type[Exception] = RuntimeError, text: str = "Simulated guard error"):
    """A rule that always raises (the fail-closed path)."""

    def evaluate(_: pd.Series) -> dict[str, Any]:
        raise exc(text)

    return evaluate


UNDECIDED = ("UndecidedCondition", "the condition is null")


def column_guard(
    name: str, fail_when: Callable[[Column], Column], action: str = "block", message: str = ""
) -> G.Guard:
    """A native user guard from one boolean column expression; null blocks."""

    class _ColumnGuard(G.Guard):
        def stages(self, text, fact):
            return [{"hit": fail_when(text)}]

        def score(self, text, fact):
            return (
                F.when(fact("hit").isNull(), R.error(self.name, *UNDECIDED))
                .when(fact("hit"), R.make(self.name, False, action, "high", message, 1.0))
                .otherwise(R.passing(self.name, ""))
            )

    g = _ColumnGuard({})
    g.name = name
    g.key = "col" + "".join(ch for ch in name.lower() if ch.isalnum())
    return g
