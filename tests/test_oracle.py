"""Every registered query against its SQL oracle (DuckDB) on the smallest test tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry
from acct_health.plans.oracle import SQL
from acct_health.plans.registry import QUERIES
from tools.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, ns, nd, _, detail = compare(spark, name, SF, QUERIES[name], SQL[name], con)
    assert ok, f"{name}: spark={ns} duck={nd} {detail}"


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns[0] == "account_id"
    assert df.count() >= 0
