"""Every registered query against its check SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from dayloom.plans.catalogue import load_all
from tests.oracle import check, connect

FOLDER = "/root/testdata/sf0.001"
# Filters that may keep nothing of tables this small.
MAY_BE_EMPTY = {"filter_after_max", "restrict_to_requested"}
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(load_all()))
def test_query_matches_sql(spark, connection, name):
    rows, problems = check(spark, connection, load_all()[name], FOLDER)
    assert not problems
    assert rows > 0 or name in MAY_BE_EMPTY


def test_entry_points(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
