"""Every query that has SQL, held against DuckDB on the smallest tables."""

import pytest

from tests.oracle import compare
from weftline.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    compare(spark, DATA, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["src", "tgt", "sim", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
