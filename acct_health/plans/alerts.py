"""Candidate selection and preview.

Plan: month-window scan (pushed filter) -> latest row per (account, month) with a map-side
partial aggregate -> one aggregate per account that carries the risk bitmask, the target-month
row and the scan counts -> broadcast routing -> message columns. Two exchanges: the first on
(account_id, month) over raw rows after partial aggregation, the second on account_id over
deduplicated rows (at most lookback+1 per account), so a hot account or a heavily duplicated
key never lands whole in one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from acct_health.functions.render import message_text
from acct_health.operators.dedup import latest_by_key
from acct_health.operators.routing import route
from acct_health.operators.streak import (
    at_risk_months,
    mask_columns,
    risk_masks,
    streak_from_masks,
    with_island_streak,
)
from acct_health.params import AT_RISK, Params, region_dim
from acct_health.session import ensure_checkpoint_dir
from acct_health.sources.account_month import (
    ACCOUNT_MONTH_COLUMNS,
    month_window,
    validate_month,
)

_TARGET_FIELDS = [c for c in ACCOUNT_MONTH_COLUMNS if c not in ("account_id", "month", "updated_at")]

ALERT_COLUMNS = ["account_id", "account_name", "account_region", "channel", "duration_months",
                 "risk_start_month", "arr", "routable", "reason", "message"]


def account_snapshot(window_df: DataFrame, target_month, lookback_months: int,
                     tie_break: str = "columns") -> DataFrame:
    """One row per account of the window: streak, target-month row (null when absent),
    ``n_rows`` scanned and ``n_keys`` distinct months."""
    latest = latest_by_key(window_df, count_col="n_versions", tie_break=tie_break)
    return snapshot_from_latest(latest, target_month, lookback_months)


def snapshot_from_latest(latest: DataFrame, target_month, lookback_months: int) -> DataFrame:
    """Per-account aggregate over deduplicated rows carrying ``n_versions`` (rows seen per key)."""
    target = validate_month(target_month)
    at_target = F.when(F.col("month") == F.lit(target), F.struct(*[F.col(c) for c in _TARGET_FIELDS]))
    aggs = [
        F.max(at_target).alias("target_row"),
        F.sum("n_versions").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
    ]
    snap = latest.groupBy("account_id").agg(*risk_masks(target, lookback_months), *aggs)
    duration, start = streak_from_masks(mask_columns(lookback_months), target)
    return snap.select("account_id", duration, start, "target_row", "n_rows", "n_keys")


def is_candidate(arr_threshold: int):
    """Target row At Risk and ARR null or at the floor (C1, C2): applied to the target row only.
    Rows without an account id fail the contract and are counted as rejected instead."""
    t = F.col("target_row")
    return (F.col("account_id").isNotNull() & t.isNotNull() & (t.getField("status") == F.lit(AT_RISK))
            & (t.getField("arr").isNull() | (t.getField("arr") >= F.lit(arr_threshold))))


def routed_snapshot(spark: SparkSession, window_df: DataFrame | None, target_month, params: Params,
                    latest: DataFrame | None = None) -> DataFrame:
    """Snapshot with candidate flag, flattened target row, channel and message for every account.
    Pass ``latest`` (deduplicated rows with ``n_versions``) instead of ``window_df`` to skip the dedup."""
    target = validate_month(target_month)
    if latest is not None:
        snap = snapshot_from_latest(latest, target, params.lookback_months)
    else:
        snap = account_snapshot(window_df, target, params.lookback_months, params.tie_break)
    flat = snap.select(
        "account_id",
        *[F.col("target_row").getField(c).alias(c) for c in _TARGET_FIELDS],
        F.lit(target).alias("month"),
        "duration_months", "risk_start_month",
        is_candidate(params.arr_threshold).alias("is_candidate"),
        "n_rows", "n_keys",
    )
    dim = region_dim(spark, params.region_channel_map)
    routed = route(flat, dim, dim_entries=len(params.region_channel_map))
    return routed.withColumn("message", F.when(F.col("is_candidate"),
                                               message_text(base_url=params.details_base_url)))


def alerts_from_snapshot(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("is_candidate")).drop("is_candidate", "n_rows", "n_keys")


def snapshot_count_columns():
    """Preview counts as aggregate columns over a routed snapshot (usable in ``agg`` or ``observe``)."""
    cand = F.col("is_candidate")
    return [
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("rows_scanned"),
        F.coalesce(F.sum(F.col("n_rows") - F.col("n_keys")), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.count(F.when(cand, 1)).cast("bigint").alias("at_risk_count"),
        F.count(F.when(cand & ~F.col("routable"), 1)).cast("bigint").alias("unknown_region_count"),
        F.coalesce(F.sum(F.when(F.col("account_id").isNull(), F.col("n_rows"))), F.lit(0))
         .cast("bigint").alias("rejected_rows"),
    ]


def counts_from_snapshot(routed: DataFrame, target_month) -> DataFrame:
    """One row with the preview counts, from a single aggregation over the snapshot."""
    return routed.agg(F.lit(validate_month(target_month)).alias("month"), *snapshot_count_columns())


def candidates(window_df: DataFrame, target_month, params: Params) -> DataFrame:
    """At-Risk accounts of the target month above the floor, with their streak."""
    target = validate_month(target_month)
    snap = account_snapshot(window_df, target, params.lookback_months, params.tie_break)
    return snap.where(is_candidate(params.arr_threshold)).select(
        "account_id",
        *[F.col("target_row").getField(c).alias(c) for c in _TARGET_FIELDS],
        "duration_months", "risk_start_month")


def materialize_candidates(spark: SparkSession, routed: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """One job: observe the counts over every account of ``routed`` while only its candidates are
    checkpointed (reliable checkpoint into the shared checkpoint folder; the account_id partitioning
    is kept for later joins). Returns (checkpointed candidates, counts)."""
    ensure_checkpoint_dir(spark)
    seen = Observation(f"counts-{name}")
    cands = (routed.observe(seen, *snapshot_count_columns())
             .where(F.col("is_candidate")).drop("is_candidate", "n_rows", "n_keys"))
    return cands.checkpoint(eager=True), dict(seen.get)


def preview(spark: SparkSession, account_month: DataFrame, target_month, params: Params | None = None,
            materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """(alerts, counts) for a month without sending or persisting anything.

    ``account_month`` is the conformed source frame; the month window is applied here. With
    ``materialize`` the snapshot is evaluated once: counts are observed while only the candidates are
    checkpointed, and both outputs come from that job.
    """
    params = params or Params()
    target = validate_month(target_month)
    window = month_window(account_month, target, params.lookback_months)
    routed = routed_snapshot(spark, window, target, params)
    if materialize:
        alerts, c = materialize_candidates(spark, routed, f"preview-{uuid.uuid4().hex}")
        names = ["rows_scanned", "duplicate_rows", "at_risk_count", "unknown_region_count", "rejected_rows"]
        counts = spark.createDataFrame([(target, *[int(c[n] or 0) for n in names])],
                                       "month date, " + ", ".join(f"{n} bigint" for n in names))
        return alerts.select(*ALERT_COLUMNS), counts
    alerts = alerts_from_snapshot(routed).select(*ALERT_COLUMNS)
    return alerts, counts_from_snapshot(routed, target)


def backfill_alerts(spark: SparkSession, account_month: DataFrame, params: Params | None = None,
                    first_month=None, last_month=None) -> DataFrame:
    """Preview alerts of every month in one pass (D9): for each first-of-month M, the rows that
    ``preview(M)`` would return, plus ``month``. One dedup over the whole history, then the capped
    island streak on the At-Risk rows (the candidates themselves, so no join), then routing.

    Equal to calling ``preview`` once per month, since a key's latest row does not depend on the
    window and ``preview`` caps streaks at lookback+1 months.
    """
    params = params or Params()
    latest = latest_by_key(account_month, tie_break=params.tie_break)
    streak = with_island_streak(at_risk_months(latest), params.lookback_months)
    floor = params.arr_threshold
    cands = streak.where(F.col("arr").isNull() | (F.col("arr") >= F.lit(floor)))
    if first_month is not None:
        cands = cands.where(F.col("month") >= F.lit(validate_month(first_month)))
    if last_month is not None:
        cands = cands.where(F.col("month") <= F.lit(validate_month(last_month)))
    dim = region_dim(spark, params.region_channel_map)
    routed = route(cands, dim, dim_entries=len(params.region_channel_map))
    return routed.select("month", *[c for c in ALERT_COLUMNS if c != "message"],
                         message_text(base_url=params.details_base_url))
