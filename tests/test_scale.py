"""Skew and plan shape: a key holding a third of all rows is pre-aggregated before any shuffle."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from acct_health.operators.dedup import latest_by_key
from acct_health.operators.ledger import current_outcomes, key_violations
from acct_health.params import Params
from acct_health.plans.alerts import preview
from acct_health.sources.fixtures import outcome_log_from_events


def _skewed(spark, n_hot=60000, n_other=120000):
    """One (account, month) key with a third of all rows, the rest spread over many accounts."""
    ids = spark.range(n_hot + n_other)
    hot = F.col("id") < n_hot
    acct = F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 5000).cast("string")))
    month = F.when(hot, F.lit(dt.date(2026, 1, 1))).otherwise(
        F.add_months(F.lit(dt.date(2026, 1, 1)), -(F.col("id") % 6).cast("int")))
    ts = F.timestamp_seconds(F.lit(1767225600) + F.col("id") % 100000).cast("timestamp_ntz")
    df = ids.select(
        acct.alias("account_id"), F.lit("name").alias("account_name"), F.lit("AMER").alias("account_region"),
        month.alias("month"),
        F.when(F.col("id") % 3 == 0, F.lit("Healthy")).otherwise(F.lit("At Risk")).alias("status"),
        F.lit(None).cast("date").alias("renewal_date"), F.lit(None).cast("string").alias("account_owner"),
        (F.col("id") % 1000).alias("arr"), ts.alias("updated_at"))
    return df


def test_hot_key_result_and_partial_aggregation(spark):
    df = _skewed(spark).repartition(8)
    latest = latest_by_key(df, count_col="n_versions")
    hot = latest.where(F.col("account_id") == "hot").collect()
    assert len(hot) == 1 and hot[0]["n_versions"] == 60000
    # winner: the greatest updated_at among the hot rows (id 59999 -> +59999 s), ties by status etc.
    assert hot[0]["updated_at"] == dt.datetime(2026, 1, 1) + dt.timedelta(seconds=59999)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    ops = re.findall(r"(Exchange hashpartitioning\(account_id#\d+, month#\d+|partial_min)", plan)
    # the partial aggregate sits below (after, in the printed tree) the exchange on the dedup key
    assert ops and ops[0].startswith("Exchange") and "partial_min" in ops[1:]


def test_preview_on_skewed_input(spark):
    alerts, counts = preview(spark, _skewed(spark), "2026-01-01", Params())
    c = counts.first()
    assert c["rows_scanned"] == 180000
    by_id = {r["account_id"]: r for r in alerts.collect()}
    assert "hot" not in by_id or by_id["hot"]["duration_months"] == 1


def test_current_outcomes_has_unique_keys(spark):
    log = outcome_log_from_events(spark, "/root/testdata/sf0.01")
    cur = current_outcomes(log, key=("account_id",))
    assert key_violations(cur, key=("account_id",)).count() == 0
    assert key_violations(log, key=("account_id",)).count() > 0  # the log itself repeats keys
