"""Request verdicts (E4 full, E5 input only).

Row flow for E4, all narrow except the response source:

    prompts -> contract (A2) -> input chain -> [vault tokenize] -> response (join or in-row)
            -> output chain -> [detokenize in row] -> verdict fold

* A request that breaks the contract gets no guard run and the verdict
  ``Request validation failed: <reason>`` (block, not allowed).
* An input block ends the request (``Request blocked by input guardrails``).
* Without ``process_with_llm`` the verdict is input-only: warn if any input
  result warns, else pass.
* A request that asked for a response but has none gets the failure verdict
  ``LLM generation failed: ResponseMissing``.
* Otherwise the output chain runs on the response; the final text has the
  vault tokens restored.  Blocked output -> no text.  Warnings are counted
  over input and output results; ``redact`` counts as pass.

The response source is a column already in the row (no shuffle: e.g. the
reply paired by A4, or a response stream joined by ``streaming.stream.with_responses``), a DataFrame keyed by ``request_id``, or a function of the
sanitized input (in-row, no shuffle), which is how an echo model is expressed.
With a response table the screened rows are left joined to it once; rows that want no
response have keys that match nothing and lie spread over all partitions.  A request with more than one response cannot be
decided: ``LLM generation failed: DuplicateResponse``.  Nothing runs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardspark import policy as PL
from guardspark.functions import patterns as P
from guardspark.operators import result as R
from guardspark.operators import vault as V
from guardspark.plans import chain
from guardspark.sources import requests as RQ

MISSING_RESPONSE_ERROR = "ResponseMissing"
DUPLICATE_RESPONSE_ERROR = "DuplicateResponse"
CONTRACT_FAILED = "Request validation failed: "


def _empty_results() -> Column:
    return F.array().cast(R.RESULTS_TYPE)


def _contract(prompts: DataFrame, text: str) -> DataFrame:
    """A2 ahead of any guard (with the reader's own errors, where the frame has them): ``__reject`` (null when acceptable) and the
    text the guards see (null for a rejected request, so no work is done)."""
    reason = RQ.contract_reason(F.col(text))
    if "reader_error" in prompts.columns:
        reason = F.coalesce(F.col("reader_error"), reason)
    return prompts.select(
        "*", reason.alias("__reject"), F.when(reason.isNull(), F.col(text)).alias("__screen")
    )


def input_only_verdict(
    prompts: DataFrame, policy: dict[str, Any] | None = None, text: str = "input_text"
) -> DataFrame:
    """E5: contract, input chain, then the input-only fold (model step off).

    A request that breaks the contract (null, empty, over 50,000 chars) gets
    no guard run: ``allowed`` false, ``block``, ``Request validation failed:
    <reason>`` - the row stays in the output.
    """
    df = chain.input_chain(_contract(prompts, text), "__screen", policy)
    rejected = F.col("__reject").isNotNull()
    results = F.when(rejected, _empty_results()).otherwise(F.col("input_results"))
    df = df.withColumn("input_results", results)
    blocked = chain.any_action(F.col("input_results"), "block")
    warned = chain.any_action(F.col("input_results"), "warn")
    return df.select(
        "*",
        (~(blocked | rejected)).alias("allowed"),
        F.when(rejected | blocked, "block")
        .when(warned, "warn")
        .otherwise("pass")
        .alias("overall_action"),
        _empty_results().alias("output_results"),
        F.lit(None).cast("string").alias("output_text"),
        F.when(rejected, F.concat(F.lit(CONTRACT_FAILED), F.col("__reject")))
        .when(blocked, P.SUMMARY_INPUT_BLOCKED)
        .otherwise(P.SUMMARY_INPUT_ONLY)
        .alias("summary"),
    ).drop("__reject", "__screen")


def request_verdict(
    prompts: DataFrame,
    responses: DataFrame | str | Callable[[Column], Column],
    policy: dict[str, Any] | None = None,
    *,
    secret: str,
    response_col: str = "output_text",
    repeated: str | None = None,
    restore: bool = True,
) -> DataFrame:
    """E4 over ``prompts(request_id, input_text, process_with_llm, ...)``.

    ``secret`` keys the vault tokens; without it they could be guessed by trying
    values.  ``output_type``, ``output_required`` and ``output_schema_given``
    columns of ``prompts`` are the output contract.  ``repeated`` names a boolean column
    that marks requests with more than one response in the row.  With ``restore`` off the tokens of a response that does not come
    from the sanitized text stay in ``output_text`` and the vault is not run: all that
    audit events need."""
    df = chain.input_chain(_contract(prompts, "input_text"), "__screen", policy)
    rejected = F.col("__reject").isNotNull()
    df = df.withColumn(
        "input_results", F.when(rejected, _empty_results()).otherwise(F.col("input_results"))
    )
    df = df.select(
        "*",
        chain.any_action(F.col("input_results"), "block").alias("__in_block"),
    )
    wants = (
        (~F.col("__in_block"))
        & ~rejected
        & F.coalesce(F.col("process_with_llm"), F.lit(False))
    )
    df = df.select("*", wants.alias("__wants"))

    vconf = PL.guard_conf(policy, "pii_vault")
    if vconf.get("enabled") and (restore or callable(responses)):
        df = df.select(
            "*", F.when(F.col("__wants"), F.col("input_text")).alias("__to_tokenize")
        )
        df = V.tokenize(
            df, "__to_tokenize", "request_id", vconf["detect_types"], secret,
            "__sanitized", "__pairs",
        ).drop("__to_tokenize")
        df = df.withColumn("__pairs", F.coalesce(F.col("__pairs"), F.array().cast(V.PAIR_TYPE)))
    else:
        df = df.select(
            "*",
            F.col("input_text").alias("__sanitized"),
            F.array().cast(V.PAIR_TYPE).alias("__pairs"),
        )

    if isinstance(responses, str):
        # the response is already in the row (e.g. a paired conversation turn)
        twice = F.lit(False) if repeated is None else F.col("__wants") & F.coalesce(F.col(repeated), F.lit(False))
        response = F.when(F.col("__wants") & ~twice, F.col(responses))
        df = df.select("*", response.alias("__response"), twice.alias("__twice"))
    elif isinstance(responses, DataFrame):
        resp = responses.groupBy(F.col("request_id").alias("__rid")).agg(
            F.min(response_col).alias("__answer"), (F.count(F.lit(1)) > 1).alias("__more")
        )
        # rows that want no response spread by their own hash and match nothing
        spread = F.when(F.col("__wants"), F.lit(0)).otherwise(F.shiftright(F.xxhash64("request_id", "input_text"), 1) * 2 + 1)
        df = df.select("*", spread.cast("long").alias("__spread"))
        resp = resp.withColumn("__zero", F.lit(0).cast("long"))
        on = (F.col("request_id") == F.col("__rid")) & (F.col("__spread") == F.col("__zero"))
        df = df.join(resp, on, "left").withColumn("__twice", F.coalesce("__more", F.lit(False)))
        df = df.withColumn("__response", F.when(~F.col("__twice"), F.col("__answer")))
    else:
        df = df.select(
            "*",
            F.when(F.col("__wants"), responses(F.col("__sanitized"))).alias("__response"),
            F.lit(False).alias("__twice"),
        )

    df = chain.output_chain(
        df, "__response", policy, "__out_results", "__out_text",
        type_col="output_type", required_col="output_required", given_col="output_schema_given",
    )
    has_response = F.col("__wants") & F.col("__response").isNotNull()
    out_results = F.when(has_response, F.col("__out_results")).otherwise(_empty_results())
    df = df.select("*", out_results.alias("output_results"))

    in_block = F.col("__in_block")
    out_block = chain.any_action(F.col("output_results"), "block")
    warned = chain.any_action(F.col("input_results"), "warn") | chain.any_action(
        F.col("output_results"), "warn"
    )
    in_warned = chain.any_action(F.col("input_results"), "warn")
    restored = F.when(
        V.has_pii(F.col("__pairs")), V.detokenize(F.col("__out_text"), F.col("__pairs"))
    ).otherwise(F.col("__out_text"))
    asked = F.coalesce(F.col("process_with_llm"), F.lit(False))

    allowed = (
        F.when(rejected, False)
        .when(in_block, False)
        .when(~asked, True)
        .when(~has_response, False)
        .when(out_block, False)
        .otherwise(True)
    )
    action = (
        F.when(rejected | in_block, "block")
        .when(~asked, F.when(in_warned, "warn").otherwise("pass"))
        .when(~has_response, "block")
        .when(out_block, "block")
        .when(warned, "warn")
        .otherwise("pass")
    )
    summary = (
        F.when(rejected, F.concat(F.lit(CONTRACT_FAILED), F.col("__reject")))
        .when(in_block, P.SUMMARY_INPUT_BLOCKED)
        .when(~asked, P.SUMMARY_INPUT_ONLY)
        .when(F.col("__twice"), P.SUMMARY_LLM_FAILED + DUPLICATE_RESPONSE_ERROR)
        .when(~has_response, P.SUMMARY_LLM_FAILED + MISSING_RESPONSE_ERROR)
        .when(out_block, P.SUMMARY_OUTPUT_BLOCKED)
        .when(warned, P.SUMMARY_WARNINGS)
        .otherwise(P.SUMMARY_OK)
    )
    output_text = F.when(has_response & ~out_block, restored)
    hidden = [c for c in df.columns if c.startswith("__")]
    return df.select(
        "*",
        allowed.alias("allowed"),
        action.alias("overall_action"),
        output_text.alias("output_text"),
        summary.alias("summary"),
    ).drop(*hidden)
