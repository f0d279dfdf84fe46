import pytest

from sparkgraft.plans.queries import ORACLES, QUERIES

from .oracle import check


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")


def test_entry_point(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns
