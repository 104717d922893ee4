"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as driver
from spanworks.queries import all_queries, all_sql
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, data_dir, name):
    df = all_queries()[name](spark, data_dir)
    if name in all_sql():
        assert difference(df, con, all_sql()[name]) == ""
    else:
        assert df.count() > 0


def test_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
