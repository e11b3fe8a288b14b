import pytest

from folioforge.operators.catalog import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import check


def test_each_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    check(QUERIES[name](spark, DATA), ORACLES[name], DATA)
