"""Every registered query against its SQL text; those without one must return rows."""

import pytest

import oracle
from mirador.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, con, name):
    assert oracle.compare(QUERIES[name](spark, data), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, data, name):
    assert QUERIES[name](spark, data).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
