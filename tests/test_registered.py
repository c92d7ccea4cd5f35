"""Every registered query against its SQL, and the shape of its plan."""

import os
import re

import pytest

import __spark_entry__ as entry
from oracle_check import connect, difference, spark_result, sql_result

from passageway.plans import oracles, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop", plan)
    ours = spark_result(df)
    if name in entry.oracle_sql():
        assert difference(ours, sql_result(con, entry.oracle_sql()[name])) is None
    else:
        assert ours[1]


def test_only_partial_probing_has_no_sql():
    assert set(registry.QUERIES) - set(oracles.ORACLES) == {"ann_topk_ivf"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
