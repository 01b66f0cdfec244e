"""The queries that have SQL, on the smallest tables."""

import pytest

from tests.oracle import compare
from weftline.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    compare(spark, DATA, queries.QUERIES[name], queries.ORACLE_SQL[name])
