"""Every registered query against its SQL twin on whole tables."""

import os

import pytest

import __spark_entry__ as entry_points
from compare_tables import differences, open_tables
from hashwave import queries as registry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return open_tables(SF_DIR)


def test_every_query_has_a_twin():
    assert set(registry.registered()) <= set(SQL) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(SQL))
def test_same_as_sql(spark, con, name):
    assert differences(entry_points.queries()[name](spark, SF_DIR), con, SQL[name]) == []


def test_flagship_runs(spark):
    assert entry_points.entry(spark).count() > 0
