"""Every registered query against its SQL counterpart, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_counterpart_has_a_query():
    assert set(oracle_sql()) <= set(queries())


# Expressions whose value changes when a lost task runs again, and joins that grow with the product of the sides.
UNSTABLE = ("uuid(", "rand(", "current_timestamp", "now()", "monotonically_increasing_id", "spark_partition_id")
PRODUCTS = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_as_sql(spark, con, name):
    df = queries()[name](spark, SF)
    if name in oracle_sql():
        assert difference(df, con, oracle_sql()[name]) is None
    else:
        assert df.count() > 0
    execution = df._jdf.queryExecution()
    analyzed, executed = execution.analyzed().toString(), execution.executedPlan().toString()
    assert not [word for word in UNSTABLE if word in analyzed]
    assert not [word for word in PRODUCTS if word in executed]


def test_entry(spark):
    outcomes = {r.outcome: r.n for r in entry(spark).collect()}
    assert outcomes["claimed"] == 100
