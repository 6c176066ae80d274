"""Every registered query with SQL gives the same values as DuckDB over the same files."""

import harness
import pytest

from promptmill.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return harness.connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, con, name):
    problem, _, rows = harness.check(spark, folder, name, con)
    assert problem is None
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
