import pytest
from oracle import assert_same
from tidemill.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    assert_same(df, ORACLE_SQL[name], data)
