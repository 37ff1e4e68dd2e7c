"""Account ids of large tables: keys longer than the padding stay whole and apart."""

import pytest
from pyspark.sql import functions as F

from acct_health.plans import registry
from acct_health.sources import fixtures

KEYS = [7, 99_999, 100_000, 100_009, 1_000_000, 1_000_001]


@pytest.fixture
def tables(spark, tmp_path):
    keys = spark.createDataFrame([(k,) for k in KEYS], "k long")
    when = F.lit("1998-06-05 00:00:00").cast("timestamp_ntz")
    parts = {
        "nation": spark.sql("SELECT 1 AS n_nationkey, 1 AS n_regionkey"), "region": spark.sql("SELECT 1 AS r_regionkey, 'ASIA' AS r_name"),
        "supplier": keys.selectExpr("k AS s_suppkey", "'s' AS s_name", "1 AS s_nationkey"),
        "customer": keys.selectExpr("k AS c_custkey", "'c' AS c_name", "1 AS c_nationkey"),
        "lineitem": keys.selectExpr("k AS l_suppkey", "4 AS l_linenumber", "10.0 AS l_quantity", "50000.0 AS l_extendedprice",
                                    "'R' AS l_returnflag", "'O' AS l_linestatus").withColumn("l_shipdate", when),
        "orders": keys.selectExpr("k AS o_custkey", "'O' AS o_orderstatus", "200000.0 AS o_totalprice", "'3-MEDIUM' AS o_orderpriority").withColumn("o_orderdate", when),
        "events": keys.selectExpr("k AS user_id", "k AS event_id", "'view' AS event_type").withColumn("ts", when),
    }
    for name, df in parts.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _ids(df):
    return sorted(r.account_id for r in df.select("account_id").collect())


def test_long_keys_stay_apart(spark, tables):
    a = ["a00007", "a100000", "a1000000", "a1000001", "a100009", "a99999"]
    assert _ids(fixtures.account_month_from_tables(spark, tables)) == a
    assert _ids(fixtures.account_month_from_orders(spark, tables)) == ["c000007", "c099999", "c100000", "c1000000", "c1000001", "c100009"]
    assert _ids(registry._current(spark, tables, True)) == a
    assert _ids(registry.QUERIES["dedup_latest"](spark, tables)) == a
