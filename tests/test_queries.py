"""Every trip query against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from meterline.plans.queries import QUERIES, SQL
from tests.oracle import connection, same

#: Those that fit a model have tests of their own.
SLOW = {"evaluate_model", "feature_importance", "score_grid", "predict_lookup", "fastest_hour", "model_findings"}

def names():
    return sorted(set(SQL) - SLOW)


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", names())
def test_same_as_sql(spark, sf, con, name):
    same(con, SQL[name], QUERIES[name](spark, sf))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
