"""Shared fixtures: one local session for the whole test run."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("guardspark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="guardspark-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s
    s.stop()


def texts_df(spark, texts, col="text"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"id long, {col} string")


def guard_results(spark, guard, texts, col="text"):
    """Apply one guard (facts then score) to texts; rows in input order."""
    from guardspark.plans import chain

    df = chain.apply_guard(texts_df(spark, texts, col), col, guard)
    return [r["r"] for r in df.orderBy("id").collect()]
