"""Edge cases through the whole preview, and metamorphic checks: order and file layout never matter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from acct_health.params import Params
from acct_health.plans.alerts import preview
from acct_health.sources.account_month import read_account_month, write_account_month
from acct_health.sources.fixtures import TARGET_MONTH, account_month_from_tables
from tests.conftest import row, write_rows

JAN = dt.date(2026, 1, 1)
T = dt.datetime(2026, 1, 2)


def test_arr_floor_null_negative_and_empty_region(spark, tmp_path):
    rows = [
        row("n1", "Null ARR", "AMER", JAN, "At Risk", T, arr=None),
        row("n2", "Negative", "AMER", JAN, "At Risk", T, arr=-1500),
        row("n3", "Zero", "EMEA", JAN, "At Risk", T, arr=0),
        row("n4", "Small", "EMEA", JAN, "At Risk", T, arr=9999),
        row("n5", "Empty region", "", JAN, "At Risk", T, arr=20000, account_owner=""),
        row("n6", "Lower case", "amer", JAN, "At Risk", T, arr=20000, renewal_date=None),
    ]
    am = read_account_month(spark, write_rows(tmp_path / "edge.parquet", rows))
    got = {r["account_id"]: r for r in preview(spark, am, JAN, Params())[0].collect()}
    assert set(got) == {"n1", "n3", "n4", "n5", "n6"}  # default floor 0 still drops negative ARR
    assert "ARR: Unknown" in got["n1"]["message"] and "ARR: $0" in got["n3"]["message"]
    assert got["n5"]["reason"] == "unknown_region" and "\nRegion: \n" in got["n5"]["message"]
    assert "Owner:" not in got["n5"]["message"]
    assert got["n6"]["routable"] is False and "Renewal date: Unknown" in got["n6"]["message"]
    floor = {r["account_id"] for r in preview(spark, am, JAN, Params(arr_threshold=10000))[0].collect()}
    assert floor == {"n1", "n5", "n6"}  # null ARR always passes the floor


def test_future_month_rows_are_ignored(spark, tmp_path):
    rows = [row("f1", "F", "AMER", JAN, "At Risk", T),
            row("f1", "F", "AMER", dt.date(2026, 2, 1), "Healthy", dt.datetime(2026, 2, 2))]
    am = read_account_month(spark, write_rows(tmp_path / "future.parquet", rows))
    alerts, counts = preview(spark, am, JAN, Params())
    assert [r["account_id"] for r in alerts.collect()] == ["f1"]
    assert counts.first()["rows_scanned"] == 1


def _result(alerts):
    return sorted(tuple(r) for r in alerts.select("account_id", "duration_months", "channel", "message").collect())


def test_row_order_and_file_layout_do_not_change_results(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    base = account_month_from_tables(spark, sf)
    expected = _result(preview(spark, base, TARGET_MONTH, Params())[0])
    assert expected
    shuffled = base.orderBy(F.rand(7)).repartition(5)
    assert _result(preview(spark, shuffled, TARGET_MONTH, Params())[0]) == expected
    path = str(tmp_path / "by_month")
    write_account_month(base, path, partitions=3)
    assert _result(preview(spark, read_account_month(spark, path), TARGET_MONTH, Params())[0]) == expected
    flat = str(tmp_path / "flat")
    base.repartition(7).write.parquet(flat)
    assert _result(preview(spark, read_account_month(spark, flat), TARGET_MONTH, Params())[0]) == expected


def test_window_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "am")
    write_account_month(account_month_from_tables(spark, "/root/testdata/sf0.001"), path, partitions=2)
    alerts, _ = preview(spark, read_account_month(spark, path), TARGET_MONTH, Params())
    plan = alerts._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "1996-06-01" in plan
    assert "ReadSchema: struct<account_id:string,account_name:string" in plan


def test_backfill_equals_one_preview_per_month(spark):
    from acct_health.plans.alerts import backfill_alerts
    base = account_month_from_tables(spark, "/root/testdata/sf0.001")
    params = Params(arr_threshold=5000)
    all_months = backfill_alerts(spark, base, params).cache()
    for month in (dt.date(1996, 3, 1), dt.date(1997, 11, 1), TARGET_MONTH):
        one = _result(preview(spark, base, month, params)[0])
        assert one == _result(all_months.where(F.col("month") == F.lit(month))), month
    assert all_months.select("month").distinct().count() > 12


def test_rows_without_account_id_are_rejected(spark, tmp_path):
    rows = [row(None, "No id", "AMER", JAN, "At Risk", T), row(None, "No id", "AMER", JAN, "At Risk", T),
            row("ok", "Fine", "AMER", JAN, "At Risk", T)]
    am = read_account_month(spark, write_rows(tmp_path / "noid.parquet", rows))
    for materialize in (False, True):
        alerts, counts = preview(spark, am, JAN, Params(), materialize=materialize)
        assert [r["account_id"] for r in alerts.collect()] == ["ok"]
        c = counts.first()
        assert (c["rows_scanned"], c["duplicate_rows"], c["at_risk_count"], c["rejected_rows"]) == (3, 1, 1, 2)
