import pytest

from sparkgraft.llm.queries import ORACLES, QUERIES

from ..oracle import check


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")
