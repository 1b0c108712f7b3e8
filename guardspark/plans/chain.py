"""Ordered guard chains (E1 input, E2 output, E3 fail closed, E6 custom).

A chain is built once on the driver from the policy (disabled guards never
enter the plan) and applied as a few ``select`` steps a guard:

1. the guard's facts, stage by stage (the redactor's running text is a
   stage per type), over the text it is handed;
2. its result struct;
3. whether the chain is blocked now, the running text, and the text handed to
   the next guard: null once blocked, so the later guards' regex work is
   not done.

The results array keeps a guard's result only if no guard before it blocked, and
the final text is the one the last guard that ran left.  No shuffle: a
chain is a narrow projection.  A null text is a guard error: the first guard
reports the fail-closed block result and the chain stops (E3).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark import policy as PL
from guardspark.operators import guards as G
from guardspark.operators import result as R
from guardspark.plancache import cached

NULL_TEXT_ERROR = ("TypeError", "object of type 'NoneType' has no len()")


_BUILTIN = (
    G.PIIDetector,
    G.PromptInjection,
    G.ToxicContent,
    G.TopicRestriction,
    G.PIIRedactor,
    G.Hallucination,
    G.ContentFilter,
    G.OutputValidator,
)


def input_guards(policy: dict[str, Any] | None = None) -> list[G.Guard]:
    """PII, injection, toxic, topic - the fixed input order."""
    guards = [
        G.PIIDetector(PL.guard_conf(policy, "pii_detector")),
        G.PromptInjection(PL.guard_conf(policy, "prompt_injection")),
        G.ToxicContent(PL.guard_conf(policy, "toxic_content")),
        G.TopicRestriction(PL.guard_conf(policy, "topic_restriction")),
    ]
    return [g for g in guards if g.enabled]


def output_guards(
    policy: dict[str, Any] | None = None,
    type_col: Column | None = None,
    required_col: Column | None = None,
    given_col: Column | None = None,
    error_col: Column | None = None,
) -> list[G.Guard]:
    """Redactor, hallucination, content filter, validator - the output order."""
    guards = [
        G.PIIRedactor(PL.guard_conf(policy, "pii_redactor")),
        G.Hallucination(PL.guard_conf(policy, "hallucination_detector")),
        G.ContentFilter(PL.guard_conf(policy, "content_filter")),
        G.OutputValidator(PL.guard_conf(policy, "output_validator"), type_col, required_col, given_col, error_col),
    ]
    return [g for g in guards if g.enabled]


class _Names:
    """Unique hidden column names for one chain application."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def col(self, *parts: str) -> str:
        return "__" + self.prefix + "_" + "_".join(parts)


def _cache_key(text, guards, results_col, final_text_col, prefix):
    """Key for a reusable chain plan, or None when one cannot be reused.

    Built-in guards are pure functions of their settings, so the same
    settings give the same expressions; user guards and per-row (Column)
    settings are rebuilt every time.
    """
    parts = []
    for g in guards:
        if type(g) not in _BUILTIN:
            return None
        if any(isinstance(v, Column) for v in g.conf.values()):
            return None
        extra = ()
        if isinstance(g, G.OutputValidator):
            extra = (str(g.type_col), str(g.required_col), str(g.given_col), str(g.error_col))
        parts.append((type(g).__name__, repr(sorted(g.conf.items(), key=lambda kv: kv[0])), extra))
    return ("chain", text, results_col, final_text_col, prefix, tuple(parts))


def _chain_plan(text, guards, results_col, final_text_col, prefix):
    """The chain as ``(steps, hidden)``: each step is one list of aliased
    Columns to add with ``select``; ``hidden`` are the helper columns."""
    names = _Names(prefix)
    steps: list[list[Column]] = []
    hidden: list[str] = []

    def add(cols: dict[str, Column]) -> None:
        if cols:
            hidden.extend(cols)
            steps.append([v.alias(k) for k, v in cols.items()])

    handed = current = F.col(text)
    blocked: Column | None = None
    kept: list[Column] = []
    for i, g in enumerate(guards):

        def fact(name: str, _i=i, _g=g, _memo={}) -> Column:  # noqa: B006 - per-guard memo
            full = names.col(str(_i), _g.key, name)
            if full not in _memo:
                _memo[full] = F.col(full)
            return _memo[full]

        for stage in g.stages(handed, fact):
            add({names.col(str(i), g.key, k): v for k, v in stage.items()})
        raw = names.col(str(i), g.key, "result")
        add({raw: g.score(handed, fact)})
        kept.append(F.col(raw) if blocked is None else F.when(~blocked, F.col(raw)))
        new_text = g.modified_text(fact)
        if new_text is not None:
            changed = new_text.isNotNull() if blocked is None else ~blocked & new_text.isNotNull()
            new_text = F.when(changed, new_text).otherwise(current)
        stops = F.coalesce(F.col(raw)["action"] == "block", F.lit(False))
        after = {names.col(str(i), "stop"): stops if blocked is None else blocked | stops}
        if new_text is not None:
            after[names.col(str(i), "text")] = new_text
        add(after)
        blocked = F.col(names.col(str(i), "stop"))
        if new_text is not None:
            current = F.col(names.col(str(i), "text"))
        if i < len(guards) - 1:
            add({names.col(str(i), "next"): F.when(~blocked, current)})
            handed = F.col(names.col(str(i), "next"))

    if guards:
        ordered = F.filter(F.array(*kept), lambda x: x.isNotNull())
        err = R.error(guards[0].name, *NULL_TEXT_ERROR)
        results = F.when(F.col(text).isNull(), F.array(err)).otherwise(ordered)
    else:
        results = F.array().cast(R.RESULTS_TYPE)
    last = {results_col: results}
    if final_text_col is not None:
        last[final_text_col] = current
    steps.append([R.sealed(**last)])
    return steps, hidden


def run_chain(
    df: DataFrame,
    text: str,
    guards: list[G.Guard],
    results_col: str,
    final_text_col: str | None = None,
    prefix: str = "g",
) -> DataFrame:
    """Add ``results_col`` (ordered results) and optionally the final text.

    Each guard sees the text as left by the guards before it (only a
    rewriting guard such as the redactor changes it).  The expressions are
    built once per settings and reused (building crosses into the JVM once
    per expression node, which costs more than analysing the plan).
    """
    key = _cache_key(text, guards, results_col, final_text_col, prefix)
    build = lambda: _chain_plan(text, guards, results_col, final_text_col, prefix)
    steps, hidden = build() if key is None else cached(key, build)
    for cols in steps:
        df = df.select("*", *cols)
    return df.drop(*hidden)


def apply_guard(df: DataFrame, text: str, guard: G.Guard, out: str = "r") -> DataFrame:
    """One guard on its own: facts, then its result struct in ``out``.

    Unlike a chain there is no short-circuit and a null text is scored as
    is (the facts are null), which is what single-guard reports want.
    """
    cols: list[str] = []

    def fact(name: str) -> Column:
        return F.col(f"__f_{name}")

    current = F.col(text)
    for stage in guard.stages(current, fact):
        df = df.select("*", *[v.alias(f"__f_{k}") for k, v in stage.items()])
        cols.extend(f"__f_{k}" for k in stage)
    df = df.select("*", guard.score(current, fact).alias(out))
    return df.drop(*cols)


def input_chain(
    df: DataFrame, text: str = "input_text", policy=None, results_col: str = "input_results"
) -> DataFrame:
    """E1."""
    return run_chain(df, text, input_guards(policy), results_col, prefix="in")


def output_chain(
    df: DataFrame,
    text: str = "output_text",
    policy=None,
    results_col: str = "output_results",
    final_text_col: str = "final_text",
    type_col: str | None = "output_type",
    required_col: str | None = "output_required",
    given_col: str | None = "output_schema_given",
    error_col: str | None = "output_error",
) -> DataFrame:
    """Results plus the text after every rewriting guard.

    The output contract comes from the row: ``type_col``, ``required_col``,
    ``given_col`` and ``error_col`` where the frame has them."""
    cols = set(df.columns)
    tcol = F.col(type_col) if type_col and type_col in cols else None
    rcol = F.col(required_col) if required_col and required_col in cols else None
    gcol = F.col(given_col) if given_col and given_col in cols else None
    ecol = F.col(error_col) if error_col and error_col in cols else None
    guards = output_guards(policy, tcol, rcol, gcol, ecol)
    return run_chain(df, text, guards, results_col, final_text_col, prefix="out")


def any_action(results: Column, action: str) -> Column:
    return F.exists(results, lambda r: r["action"] == action)
