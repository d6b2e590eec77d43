"""Every registered query against its SQL twin on the smallest test tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import duck, duck_rows, spark_rows, type_mismatch

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()
QUERIES = queries()
# Whole sweeps have tests of their own on signals with a known answer.
LONG = {"sweep_results", "sweep_results_tensor"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    columns, got = spark_rows(df)
    want_columns, want = duck_rows(con, SQL[name])
    assert columns == want_columns
    assert type_mismatch(con, SQL[name], df) == {}
    assert got == want


OWN_TESTS = {n for n, q in QUERIES.items() if not q.__module__.startswith("wavemill.plans")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LONG - OWN_TESTS))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["participant", "task", "classifier", "accuracy"]


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
