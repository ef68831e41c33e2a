"""Every query with an oracle gives DuckDB's rows."""

import pytest

from lorespark.plans.all_queries import ORACLES, QUERIES
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, ORACLES[name])


def test_all_others_have_value_checks():
    """Queries that SQL does not express are compared with plain Python in test_values.py."""
    from tests import test_values

    assert set(QUERIES) - set(ORACLES) == set(test_values.CHECKED)
