"""Every graph query against its SQL at sf0.01."""

import pytest
from compare import SF, assert_same, connect

from weftgraph.workload import CASES, queries


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", [n for n, c in CASES.items() if c.sql])
def test_same_rows_as_sql(spark, con, name):
    assert_same(queries()[name](spark, SF), CASES[name].sql, con)


def test_known_counts(spark):
    assert queries()["khop_filtered"](spark, SF).count() == 1156
    assert queries()["anti_basic"](spark, SF).count() == 4810
