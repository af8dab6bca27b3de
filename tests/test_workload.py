"""Every registered query with SQL gives the rows DuckDB gives."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

from shared_rows import SF_DIR

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_same_rows(spark, connection, name):
    same, note = compare(spark, connection, name, SF_DIR)
    if same is None:
        pytest.skip(note)
    assert same, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
