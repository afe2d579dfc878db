"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import OPERATOR, check, connect

FOLDER = "/root/testdata/sf0.001"
# The text operators have tests of their own.
QUERIES = {n: q for n, q in contract.queries().items() if n != "pipeline" and not OPERATOR.match(n)}
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_oracle(spark, con, name):
    problem, rows = check(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
