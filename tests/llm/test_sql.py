import pytest

from shoplake.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLE_SQL[name]) > 0
