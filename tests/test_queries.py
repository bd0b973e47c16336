import pytest

from .oracle import compare, connect

import kgspark.plans.more_queries  # noqa: F401  (adds its queries)
from kgspark.plans import queries
from kgspark.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.fixture(scope="module", autouse=True)
def one_evaluation(spark):
    """The queries of the evaluation share one here; each makes its own otherwise."""
    made = {}
    plain = queries._evaluation
    queries._evaluation = lambda spark, sf: made.get(sf) or made.setdefault(sf, plain(spark, sf))
    yield
    queries._evaluation = plain


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    compare(QUERIES[name](spark, DATA), con, ORACLES[name])


def test_matching_has_conflicts(spark):
    """Predictions compete for gold triples, so the matching is smaller than the edges."""
    assert QUERIES["greedy_match"](spark, DATA).count() < QUERIES["alignment_edges"](spark, DATA).count()
