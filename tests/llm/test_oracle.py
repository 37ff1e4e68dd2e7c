"""Every query of the subpackage that SQL can express, against its SQL."""

import pytest

from acct_health.llm.registry import QUERIES, SQL
from tools.oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, ns, nd, _, detail = compare(spark, name, FOLDER, QUERIES[name], SQL[name], con)
    assert ok, f"{name}: spark={ns} duck={nd} {detail}"
