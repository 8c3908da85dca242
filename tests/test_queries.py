"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
from compare import compare, connect
from loadwatch_queries import baselines, contracts, monitors, rules, sources

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
# The others read the same validated history, one validation each: ALL_QUERIES=1 runs them too (tools/compare.py as well).
QUICK = [*sources.QUERIES, *contracts.QUERIES, *rules.QUERIES, *baselines.QUERIES, *[n for n in monitors.QUERIES if not n.startswith("history")],
         "all_incidents", "daily_indicators"]
NAMES = list(entry_point.queries()) if os.environ.get("ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, SF, name, entry_point.queries()[name], entry_point.oracle_sql().get(name)) is None


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_query_has_sql():
    """All but those of the corpus operators, which have tests of their own where SQL cannot express them."""
    own = {n for module in entry_point.MODULES if module.__name__.startswith("loadwatch_queries") for n in module.QUERIES}
    assert own <= set(entry_point.oracle_sql()) <= set(entry_point.queries())
