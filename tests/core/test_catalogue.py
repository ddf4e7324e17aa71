"""Every query against its SQL on the smallest tables."""

import pytest

from tests.compare import difference, tables
from tidemark.plans import catalogue

SLOW = {"rf_fit_score", "gbt_importance", "rf_attribution"}  # in test_models.py


@pytest.fixture(scope="module")
def con(sf):
    return tables(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sf, con, name):
    assert difference(catalogue.QUERIES[name](spark, sf), con.sql(catalogue.ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_gives_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_conversation_state_is_the_batch_result(spark, sf):
    folded = {r.conv: set(filter(None, r.positive.split(","))) for r in catalogue.QUERIES["stream_conversation"](spark, sf).collect()}
    batch = {}
    for r in catalogue.QUERIES["conv_state_last_polarity"](spark, sf).collect():
        batch.setdefault(r.conv, set())
        if r.positive:
            batch[r.conv].add(r.code)
    assert folded == batch
