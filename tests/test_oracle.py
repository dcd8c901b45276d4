"""Every query with a SQL twin gives the same columns, types and rows in both engines."""

import pytest

from checks.compare import difference, engine
from checks.oracles import ORACLES
from checks.queries import FITS, QUERIES
from ebbline.plans import models
from tests.conftest import FOLDER


@pytest.fixture(scope="module")
def other_engine():
    return engine(FOLDER)


# Searches of many fits: tests/test_models.py has small ones.
SEARCHES = {"random_search_small", "grid_search"}
SMALL = {
    "logistic": lambda rows: models.fit_logistic(rows, max_iter=50),
    "forest": lambda rows: models.fit_forest(rows, trees=10, depth=5),
    "gbt_a": lambda rows: models.fit_gbt(rows, "a", maxIter=5, maxDepth=3),
    "gbt_b": lambda rows: models.fit_gbt(rows, "b", maxIter=5, maxDepth=3),
}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SEARCHES))
def test_same_rows(spark, other_engine, name, monkeypatch):
    # What the twins state of models holds at any budget.
    for model, fit in SMALL.items():
        monkeypatch.setitem(FITS, model, fit)
    assert difference(QUERIES[name](spark, FOLDER), other_engine, ORACLES[name]) is None


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_gives_rows(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
