"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import oracle

from graphlode import plans

SF = "/root/testdata/sf0.001"
plans.load_all()


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(SF):
        pytest.skip("no tables here")
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, con, name):
    found, _ = oracle.differences(spark, SF, plans.QUERIES[name], plans.ORACLES[name], con)
    assert not found


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, con, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark, con):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
