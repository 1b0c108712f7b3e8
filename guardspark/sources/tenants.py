"""Per-tenant policy (A5).

A driver-side policy is merged with ``policy.overlay`` and folded into
literals.  When thresholds and actions differ by tenant, they come from a
policy table joined to the requests; the guards accept Columns wherever
they accept numbers or strings, so the chain is the same code.

A request whose tier has no row, or no tier at all, gets the default policy.
A threshold or action that is null all the same (a hole in the table) blocks:
the guards fail closed on it.  A tier that is listed more than once has no decided
settings: all of them are null, so its requests block, once each.

The policy table is configuration; the join is a plain one and Spark chooses
its form by the table's bytes, which are known of ``policy_table``: the texts stay where they are read.
Where a table is not broadcast, the texts are shuffled, and a few tiers hold all requests: each tier's
requests (those without a tier too) are dealt over ``SPREAD`` keys, so no task reads a whole tier.
"""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardspark import policy as PL
from guardspark.plans import verdict

# Tier settings: (tier, pii threshold, pii action, injection threshold,
# toxic action, topic action).
TIERS: list[tuple[str, float, str, float, str, str]] = [
    ("strict", 0.7, "block", 0.6, "block", "block"),
    ("standard", 0.8, "warn", 0.7, "block", "warn"),
    ("lenient", 0.9, "warn", 0.9, "warn", "warn"),
]

#: Keys that the requests of one tier are dealt over.
SPREAD = 32

# Column of the policy table -> (guard, setting) it overrides.
SETTINGS: dict[str, tuple[str, str]] = {
    "pii_threshold": ("pii_detector", "confidence_threshold"),
    "pii_action": ("pii_detector", "action"),
    "injection_threshold": ("prompt_injection", "confidence_threshold"),
    "toxic_action": ("toxic_content", "action"),
    "topic_action": ("topic_restriction", "action"),
}


def policy_table(spark: SparkSession) -> DataFrame:
    """Tier rows keyed by ``tenant_tier``; from Arrow, as Spark knows no size of a table made from a list."""
    names = ["tenant_tier", "pii_threshold", "pii_action", "injection_threshold", "toxic_action", "topic_action"]
    return spark.createDataFrame(pa.table([list(c) for c in zip(*TIERS, strict=True)], names=names))


def attach_policy(
    requests: DataFrame, table: DataFrame, key: str = "tenant_tier", default: dict[str, Any] | None = None
) -> DataFrame:
    """The policy columns of every request; those of ``default`` (the shipped
    policy) where its tier has no row."""
    once = F.count(F.lit(1)) == 1
    settings = [F.when(once, F.first(col)).alias(col) for col in SETTINGS]
    single = table.groupBy(key).agg(*settings, F.lit(True).alias("__known"))
    dealt = single.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    plain = [f.name for f in requests.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    deal = F.pmod(F.xxhash64(*plain), F.lit(SPREAD)).cast("int")
    joined = requests.withColumn("__deal", deal).join(dealt, [key, "__deal"], "left").drop("__deal")
    known = F.coalesce(F.col("__known"), F.lit(False))
    out = {
        col: F.when(known, F.col(col)).otherwise(F.lit(PL.guard_conf(default, guard)[setting]))
        for col, (guard, setting) in SETTINGS.items()
    }
    return joined.withColumns(out).drop("__known")


def tenant_input_verdict(prompts: DataFrame, table: DataFrame, key: str = "tenant_tier") -> DataFrame:
    """E5 with per-row thresholds and actions from the tenant's tier."""
    df = attach_policy(prompts, table, key)
    guards: dict[str, dict[str, Any]] = {}
    for col, (guard, setting) in SETTINGS.items():
        guards.setdefault(guard, {})[setting] = F.col(col)
    return verdict.input_only_verdict(df, PL.overlay(PL.DEFAULT_POLICY, {"input_guards": guards}))
