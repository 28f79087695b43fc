"""Every named query against its SQL oracle, over whole tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from tidewatch.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, con, small, name):
    diff = compare(spark, con, name, small)
    # Tiny data may leave a detector silent; that both sides are is still a match.
    assert [d for d in diff if d != "no rows at all"] == []


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_names_the_root(spark):
    rows = {r.run_id: r for r in entry.entry(spark).collect()}
    assert rows["unit-change-large-month"].root == "events"
    assert rows["mart-null-large-month"].root == "fct_events"
