"""Every registered query against its SQL, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_queries  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return check_queries.connect(sf)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sf, con, name):
    result = check_queries.compare(spark, con, sf, name)
    assert result.startswith(("ok", "rows-only")), result


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"source", "kind", "tokens", "rows"}
