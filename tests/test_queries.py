import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            connection.sql(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return connection


def multiset(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(str([row[k] for k in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_matches_sql(spark, sql, name):
    found, expected = core.QUERIES[name](spark, SF), sql.sql(core.ORACLE[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert multiset([tuple(r) for r in found.collect()], found.columns) == multiset(expected.fetchall(), expected.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = core.QUERIES["select_source_bindings"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_custkey" not in plan
    plan = core.QUERIES["full_load_dedup_multi_pk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
