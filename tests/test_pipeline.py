"""End to end: preview, run, replay idempotency, dry run, failed load, retries of failures."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from acct_health.operators.ledger import current_outcomes, read_log, read_replays, read_runs
from acct_health.plans.alerts import preview
from acct_health.plans.run import run_month, run_status
from acct_health.sources.account_month import read_account_month

from tests.conftest import SAMPLE_ROWS, TARGET, FakeTransport, posts, row, write_rows


@pytest.fixture
def ledger(tmp_path):
    return str(tmp_path / "ledger")


def _run(spark, source, ledger, params, transport=None, **options):
    return run_month(spark, source, TARGET, ledger, params, transport=transport or FakeTransport(200), sleep=lambda s: None, **options)


def _counts(spark, ledger, run_id):
    c = run_status(spark, ledger, run_id)["counts"]
    return c["alerts_sent"], c["skipped_replay"], c["failed_deliveries"]


def test_preview_of_the_sample(spark, sample_parquet, params):
    alerts, counts = preview(spark, read_account_month(spark, sample_parquet), TARGET, params)
    c = counts.first()
    assert (c["rows_scanned"], c["duplicate_rows"], c["at_risk_count"], c["unknown_region_count"]) == (16, 2, 4, 2)
    got = {r["account_id"]: (r["duration_months"], r["risk_start_month"].isoformat(), r["channel"], r["reason"]) for r in alerts.collect()}
    assert got == {"birch": (2, "2024-02-01", "emea-risk-alerts", None), "cedar": (5, "2023-11-01", "apac-risk-alerts", None),
                   "dune": (1, "2024-03-01", None, "unknown_region"), "gum": (1, "2024-03-01", None, "unknown_region")}


def test_second_run_posts_nothing(spark, sample_parquet, params, ledger, tmp_path):
    tr = FakeTransport(200, str(tmp_path))
    first = _run(spark, sample_parquet, ledger, params, tr)
    status = run_status(spark, ledger, first)
    assert _counts(spark, ledger, first) == (2, 0, 2) and status["status"] == "succeeded"
    assert [a["account_id"] for a in status["sample_alerts"]] == ["birch", "cedar"]
    assert {(e["account_id"], e["reason"]) for e in status["sample_errors"]} == {("dune", "unknown_region"), ("gum", "unknown_region")}
    sent = sorted(posts(str(tmp_path)))
    assert sent == [f"http://localhost:9000/hook/{c} at_risk|{a}|2024-03-01" for c, a in [("apac-risk-alerts", "cedar"), ("emea-risk-alerts", "birch")]]

    second = _run(spark, sample_parquet, ledger, params, tr)
    assert _counts(spark, ledger, second) == (0, 2, 2)
    assert sorted(posts(str(tmp_path))) == sent and run_status(spark, ledger, second)["sample_alerts"] == []
    # the lookup table holds no row for what was skipped
    assert read_log(spark, ledger).where("status = 'skipped_replay'").count() == 0
    assert {r["account_id"] for r in read_replays(spark, ledger).collect()} == {"birch", "cedar"}
    current = current_outcomes(read_log(spark, ledger)).where("status = 'sent'").collect()
    assert {(r["account_id"], r["run_id"]) for r in current} == {("birch", first), ("cedar", first)}


def test_dry_runs_store_and_post_nothing(spark, sample_parquet, params, ledger, tmp_path):
    before = _run(spark, sample_parquet, ledger, params, FakeTransport(200, str(tmp_path)), dry_run=True)
    assert posts(str(tmp_path)) == [] and read_log(spark, ledger).count() == 0
    assert _counts(spark, ledger, before) == (2, 0, 2) and run_status(spark, ledger, before)["dry_run"]
    _run(spark, sample_parquet, ledger, params)
    after = _run(spark, sample_parquet, ledger, params, dry_run=True)
    assert _counts(spark, ledger, after) == (2, 0, 2)  # a dry run says what would be sent, sent before or not


def test_failures_are_tried_again_by_the_next_run(spark, sample_parquet, params, ledger):
    down = _run(spark, sample_parquet, ledger, params, FakeTransport(502))
    assert _counts(spark, ledger, down) == (0, 0, 4)
    errors = {e["account_id"]: e for e in run_status(spark, ledger, down)["sample_errors"]}
    assert errors["cedar"]["reason"] == "delivery_failed" and "502" in errors["cedar"]["error"]
    up = _run(spark, sample_parquet, ledger, params)
    assert _counts(spark, ledger, up) == (2, 0, 2)
    assert _counts(spark, ledger, down) == (0, 0, 4) and run_status(spark, ledger, down)["sample_errors"] == []


def test_region_taken_off_the_map_after_sending(spark, sample_parquet, params, ledger):
    _run(spark, sample_parquet, ledger, params)
    fewer = dataclasses.replace(params, region_channel_map={"EMEA": "emea-risk-alerts"})
    assert _counts(spark, ledger, _run(spark, sample_parquet, ledger, fewer)) == (0, 1, 3)
    cedar = current_outcomes(read_log(spark, ledger)).where("account_id = 'cedar'").first()
    assert cedar["status"] == "sent"  # sent stays sent


def test_source_that_is_not_there(spark, params, ledger, tmp_path):
    rid = _run(spark, f"file://{tmp_path}/nowhere.parquet", ledger, params)
    run = read_runs(spark, ledger).where(F.col("id") == rid).first()
    assert run["status"] == "failed" and run["error"].startswith("AnalysisException")
    assert run_status(spark, ledger, "never-ran") is None


def test_real_run_without_a_transport(spark, sample_parquet, params, ledger):
    rid = run_month(spark, sample_parquet, TARGET, ledger, params)
    run = read_runs(spark, ledger).where(F.col("id") == rid).first()
    assert run["status"] == "failed" and "transport" in run["error"] and read_log(spark, ledger).count() == 0


def test_waves_read_their_own_slice(spark, sample_parquet, params):
    from acct_health.operators.ledger import decide
    from acct_health.plans.run import store_decisions
    from acct_health.plans.alerts import alerts_from_snapshot, routed_snapshot
    from acct_health.sources.account_month import month_window
    alerts = alerts_from_snapshot(routed_snapshot(spark, month_window(read_account_month(spark, sample_parquet), TARGET, 24), TARGET, params))
    sent = spark.createDataFrame([("cedar",)], "account_id string")
    decisions, found = store_decisions(spark, decide(alerts, sent, dry_run=False), waves=4, tasks=2)
    assert (found["skipped_replay"], found["send"], found["unknown_region"]) == (1, 1, 2)
    assert {(r["account_id"], r["decision"], r["wave"] >= 0) for r in decisions.collect()} == {
        ("birch", "send", True), ("cedar", "skipped_replay", False), ("dune", "unknown_region", False), ("gum", "unknown_region", False)}
    plan = decisions.where("wave = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(wave" in plan and "Join" not in plan


def test_run_without_a_target_url(spark, sample_parquet, ledger):
    from acct_health.params import Params
    rid = _run(spark, sample_parquet, ledger, Params())
    run = read_runs(spark, ledger).where(F.col("id") == rid).first()
    assert run["status"] == "failed" and "webhook" in run["error"]


def test_digest_of_a_run(spark, sample_parquet, params, ledger):
    rid = _run(spark, sample_parquet, ledger, dataclasses.replace(params, support_email="desk@example.org"))
    (d,) = spark.read.parquet(f"{ledger}/digests").where(F.col("run_id") == rid).collect()
    assert (d["to"], d["n_accounts"], d["n_lines"], d["part"]) == ("desk@example.org", 2, 2, 0)
    assert d["body"].split("\n")[1:] == ["  - dune (Dune SA) region=None", "  - gum (Gum LLC) region='ANTARCTICA'"]


def test_scan_order_tie_break_end_to_end(spark, sample_parquet, params, ledger):
    scan = dataclasses.replace(params, tie_break="scan_order")
    am = read_account_month(spark, sample_parquet, scan_position=True)
    alerts, counts = preview(spark, am, TARGET, scan)
    assert sorted(r["account_id"] for r in alerts.collect()) == ["birch", "cedar", "dune", "gum"]
    assert counts.first()["duplicate_rows"] == 2
    assert _counts(spark, ledger, _run(spark, sample_parquet, ledger, scan)) == (2, 0, 2)


def test_month_without_candidates(spark, sample_parquet, params, ledger):
    rid = run_month(spark, sample_parquet, "2030-01-01", ledger, params, transport=FakeTransport(200), sleep=lambda s: None)
    st = run_status(spark, ledger, rid)
    assert st["status"] == "succeeded" and set(st["counts"].values()) == {0}


def test_run_records_rejected_rows(spark, params, ledger, tmp_path):
    path = write_rows(tmp_path / "with_null.parquet", [*SAMPLE_ROWS, row(None, "No id", "AMER", TARGET, "At Risk", None)])
    st = run_status(spark, ledger, _run(spark, path, ledger, params))
    assert (st["rejected_rows"], st["counts"]["rows_scanned"], st["counts"]["alerts_sent"]) == (1, 17, 2)
