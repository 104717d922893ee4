"""The text queries on whole tables, against their SQL where there is some."""

import pytest

import __spark_entry__ as driver
from spanworks.llm.queries import llm_queries, llm_sql
from tests.compare import connect, difference


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_query(spark, data_dir, name):
    df = llm_queries()[name](spark, data_dir)
    if name in llm_sql():
        assert difference(df, connect(data_dir), llm_sql()[name]) == ""
    else:
        assert df.count() > 0


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} <= {name.split("_")[0] for name in driver.queries()}
    assert "pipeline" in driver.queries()
