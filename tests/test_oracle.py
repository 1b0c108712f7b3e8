"""Every registered query against its DuckDB twin (small scale)."""

import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from guardspark.plans import catalog, oracle
from oracle_check import compare


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert "overall_action" in df.columns


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, name):
    rep = compare(spark, SF_SMALL, [name], verbose=False)
    assert rep[name][0] == "match" and rep[name][1] > 0, rep[name]


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) == set(oracle.ORACLE_SQL)
    assert set(catalog.QUERIES) <= set(E.queries()) and set(oracle.ORACLE_SQL) <= set(E.oracle_sql())


FLAT = ("bigint", "int", "string", "boolean", "double", "timestamp", "timestamp_ntz")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_columns_are_flat(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    nested = {f.name: f.dataType.simpleString() for f in df.schema.fields
              if f.dataType.simpleString() not in FLAT}
    assert not nested, nested
