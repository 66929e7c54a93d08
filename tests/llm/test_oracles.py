"""Queries with SQL against DuckDB, and the registration of all operators."""

import pytest

import __spark_entry__ as E
from revlens.llm import queries
from tests.compare import compare_one, duck_connect
from tests.conftest import SF0001, SF001


@pytest.mark.parametrize("sf", [SF0001, SF001])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    r = compare_one(spark, duck_connect(sf), name, queries.QUERIES[name], queries.ORACLE_SQL[name], sf)
    assert r["cols"] and r["rows"] and r["values"], r["detail"]


def test_every_operator_and_the_pipeline_are_registered():
    names = list(E.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(E.oracle_sql())
