"""Every registered query against its independent SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import workload
from tools import check

SF = "/root/testdata/sf0.001"
QUERIES, SQL = workload.QUERIES, workload.ORACLES


@pytest.fixture(scope="module")
def con():
    return check.database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, why, _, _ = check.compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert ok, why


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 14
