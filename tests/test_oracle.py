"""Every registered query with oracle SQL must equal DuckDB on sf0.01."""
import pytest

from cases import SF01
from flowsight.plans.all import ORACLE, QUERIES
from oracle_check import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    err = compare(QUERIES[name](spark, SF01), con, ORACLE[name])
    assert err is None, f"{name}: {err}"
