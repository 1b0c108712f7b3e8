"""Plan shape: chains add no shuffle, filters and columns reach the scan."""

from conftest import SF_ORACLE

from guardspark.operators import audit as A
from guardspark.plans import chain, verdict
from guardspark.sources import requests as RQ
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    return spark.read.parquet(f"{SF_ORACLE}/documents.parquet")


def test_input_only_verdict_is_map_only(spark):
    p = plan_of(verdict.input_only_verdict(RQ.prompts(docs(spark))))
    assert "Exchange" not in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_output_chain_is_map_only(spark):
    conv = spark.read.parquet(f"{SF_ORACLE}/conversations.parquet").filter(F.col("role") == "assistant")
    p = plan_of(chain.output_chain(conv.select("conv_id", "turn", F.col("text").alias("output_text"))))
    assert "Exchange" not in p
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)]" in p


def test_rollups_aggregate_before_shuffle(spark):
    vals = A.pii_values(docs(spark), "text", ["doc_id", "source"])
    p = plan_of(A.pii_by_source(vals))
    assert "partial_count" in p
    assert p.index("Exchange") < p.rindex("partial_count")


def test_turn_pairs_shuffle_the_texts_once(spark):
    conv = spark.read.parquet(f"{SF_ORACLE}/conversations.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_of(RQ.turn_pairs(conv))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # all rows by bucket; per bucket its first row, and those by conversation, then by bucket again
    assert p.count("Exchange hashpartitioning") == 4
    assert "windowspecdefinition(conv_id" in p and "bucket" in p


def test_events_leave_the_vault_out(spark):
    from guardspark.plans import catalog as C

    p = plan_of(C.guard_rollup(spark, SF_ORACLE))
    assert "sha2" not in p
    assert "sha2" in plan_of(C.request_verdict(spark, SF_ORACLE))


def test_a_verdict_is_planned_without_a_job(spark):
    from guardspark.plans import catalog as C

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning only")
    try:
        C.request_verdict_join(spark, SF_ORACLE)
        assert not tracker.getJobIdsForGroup("planning") or all(
            len(tracker.getJobInfo(j).stageIds) <= 1 for j in tracker.getJobIdsForGroup("planning")
        )
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_read_table_deals_rows_only_when_told(spark):
    from guardspark.session import read_table

    assert "Exchange" not in plan_of(read_table(spark, SF_ORACLE, "documents"))
    assert "RoundRobinPartitioning(6)" in plan_of(read_table(spark, SF_ORACLE, "documents", partitions=6))
