"""Registered queries: those with SQL against DuckDB, names and rows of the others."""

import oracle
import pytest

from mirador.llm import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, con, name):
    assert oracle.compare(QUERIES[name](spark, data), con, ORACLES[name]) is None


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
