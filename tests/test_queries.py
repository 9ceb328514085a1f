"""Every registered query against its SQL twin, and the driver contract."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from checks import REGISTRY
from tests.compare import connect, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, con, name):
    entry = REGISTRY[name]
    columns, rows = spark_rows(entry.query(spark, FOLDER))
    assert rows
    if entry.sql is not None:
        assert (columns, rows) == sql_rows(con, entry.sql)


def test_driver_contract(spark):
    assert entry_module.entry(spark).count() == 10
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
