"""Every registered query against its SQL on the provided tables."""

from __future__ import annotations

from dataclasses import replace

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from panelreg.catalog import REGISTRY, tree_queries
from tests.check_queries import compare, duck

SF_DIR = "/root/testdata/sf0.01"
SQL = oracle_sql()


@pytest.fixture
def con():
    """A database of its own for each query: one that fails cannot take the others with it."""
    with duck(SF_DIR) as connection:
        yield connection


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    ours = queries()[name](spark, SF_DIR).toPandas()
    assert len(ours)
    if name in SQL:
        assert compare(ours, con.execute(SQL[name]).df()) == "ok"


def test_entry(spark):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("name, changed", [("boost_regularized", {"alpha": 0.0}), ("boost_regularized", {"gamma": 0.0}), ("forest_two_levels", {})])
def test_sql_tells_another_model(spark, con, monkeypatch, name, changed):
    """The SQL of the models follows their settings: a model with others doesn't meet it."""
    if changed:
        monkeypatch.setattr(tree_queries, "DEEP", replace(tree_queries.DEEP, **changed))
    else:
        monkeypatch.setattr(tree_queries, "TRIED", 6)
    ours = queries()[name](spark, SF_DIR).toPandas()
    assert compare(ours, con.execute(SQL[name]).df()) != "ok"
