"""Every corpus query with SQL against DuckDB at sf0.01."""

import pytest
from compare import SF, assert_same, connect

from weftgraph.llm.workload import oracle_sql, queries


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert_same(queries()[name](spark, SF), oracle_sql()[name], con)
