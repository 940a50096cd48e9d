import pytest
from oracle import assert_same
from tidemill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_matches_its_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data), ORACLE_SQL[name], data)
