"""Bucketed tables, file ordinals and ordered digest parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from acct_health.operators.dedup import latest_by_key
from acct_health.operators.digest import unknown_region_digest
from acct_health.operators.streak import streaks_all
from acct_health.session import scratch_path
from acct_health.sources.account_month import file_ordinals, month_window, read_account_month, write_account_table

from tests.conftest import TARGET


def _rows(df):
    return sorted(map(str, df.collect()))


def _exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_bucketed_table_needs_no_exchange(spark, sample_parquet):
    plain = read_account_month(spark, sample_parquet)
    own = write_account_table(plain, "am_bucketed_test", scratch_path(spark, "bucketed"), 4)
    try:
        for form in (lambda am: latest_by_key(month_window(am, TARGET, 24)), lambda am: streaks_all(latest_by_key(am), 24)):
            assert _rows(form(own)) == _rows(form(plain))
            assert _exchanges(form(own)) == 0 and _exchanges(form(plain)) > 0
    finally:
        spark.sql("DROP TABLE am_bucketed_test")


def test_file_ordinals_are_the_path_order(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 200, 1, 25).write.parquet(path)
    got = [(r["_file"], r["_file_ord"]) for r in file_ordinals(spark.read.parquet(path)).collect()]
    names = sorted(f for f, _ in got)
    assert sorted(got, key=lambda x: x[1]) == [(f, i) for i, f in enumerate(names)] and len(names) == 25
    empty = spark.read.schema("id long").parquet(path).where("id < 0")
    assert file_ordinals(empty).count() == 0


def test_parts_of_a_digest_in_order_are_the_whole(spark):
    routed = spark.range(997).select(
        F.concat(F.lit("acc"), F.col("id").cast("string")).alias("account_id"), F.lit("N").alias("account_name"),
        F.lit(None).cast("string").alias("account_region"), F.lit(False).alias("routable"))
    lines = lambda n: [x for r in sorted(unknown_region_digest(routed, "r", 997, n).collect(), key=lambda r: r["part"])
                       for x in r["body"].split("\n")[1:]]
    assert lines(4) == lines(1) and len(lines(1)) == 997
