"""Every registered query against its SQL on the smallest folder."""

import pytest

from retailscope.plans.catalog import CHECKS, QUERIES
from tests.compare import compare, connect
from tests.conftest import SMALL

# fits of whole model families; their parts are tested elsewhere
SLOW = {"m14_hist_gradient_boosting", "m14_random_forest", "m14_regularized_boosting", "m19_model_selection", "m21_scored_requests"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    ok, text = compare(spark, duck, name, QUERIES[name], CHECKS.get(name), SMALL)
    assert ok, text
