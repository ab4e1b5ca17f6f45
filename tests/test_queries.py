"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tonewise import workload
from tests.compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def twin():
    return duck(SF)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query(spark, twin, name):
    status, rows, _, _ = compare(spark, twin, name, SF)
    assert status in ("ok", "rows-only"), status
    assert rows > 0 or name in entry.oracle_sql()


def test_entry(spark):
    frame = entry.entry(spark)
    assert set(frame.columns) == {"topic", "positive", "negative", "neutral"}
