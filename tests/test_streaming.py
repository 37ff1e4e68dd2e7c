"""Streaming forms: several micro-batches give the batch result; a late correction flips an alert."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from acct_health.operators.dedup import latest_by_key

from acct_health.params import Params
from acct_health.plans.alerts import preview
from acct_health.sources.account_month import SourceContractError, read_account_month
from acct_health.streaming.stream import (
    FeedContract,
    compact_latest,
    latest_stream,
    read_alerts,
    read_feed,
    read_latest,
    rejected_rows,
    run_alert_stream,
    run_latest_stream,
)
from tests.conftest import ARROW_SCHEMA, SAMPLE_ROWS, TARGET, row, write_rows


def test_stream_equals_batch_across_microbatches(spark, tmp_path, params):
    feed_dir = tmp_path / "feed"
    feed_dir.mkdir()
    for i, r in enumerate(SAMPLE_ROWS):  # one row per file, one file per trigger
        write_rows(feed_dir / f"f{i:02d}.parquet", [r])
    out, ckpt = str(tmp_path / "latest"), str(tmp_path / "ckpt")
    run_latest_stream(spark, read_feed(spark, str(feed_dir), 1), out, ckpt)
    assert spark.read.parquet(out).select("batch_id").distinct().count() > 1
    got = {(r["account_id"], r["month"]): (r["status"], r["n_versions"]) for r in read_latest(spark, out).collect()}
    assert got[("elm", TARGET)] == ("Healthy", 3)

    state, ckpt2 = str(tmp_path / "state"), str(tmp_path / "ckpt2")
    run_alert_stream(spark, read_feed(spark, str(feed_dir), 2), TARGET, params, state, ckpt2)
    batch, _ = preview(spark, read_account_month(spark, str(feed_dir)), TARGET, params)
    key = ["account_id", "duration_months", "channel", "message"]
    assert sorted(map(tuple, read_alerts(spark, state).select(key).collect())) == \
        sorted(map(tuple, batch.select(key).collect()))


def test_late_correction_updates_alert_state(spark, tmp_path):
    feed_dir = tmp_path / "feed"
    feed_dir.mkdir()
    jan, dec = dt.date(2026, 1, 1), dt.date(2025, 12, 1)
    write_rows(feed_dir / "f0.parquet", [row("a1", "A", "AMER", dec, "At Risk", dt.datetime(2025, 12, 2)),
                                         row("a1", "A", "AMER", jan, "At Risk", dt.datetime(2026, 1, 2))])
    state, ckpt = str(tmp_path / "state"), str(tmp_path / "ckpt")
    params = Params()
    run_alert_stream(spark, read_feed(spark, str(feed_dir)), jan, params, state, ckpt)
    assert read_alerts(spark, state).first()["duration_months"] == 2
    # a late correction of December ends the streak; the same query continues from its checkpoint
    write_rows(feed_dir / "f1.parquet", [row("a1", "A", "AMER", dec, "Healthy", dt.datetime(2025, 12, 20))])
    run_alert_stream(spark, read_feed(spark, str(feed_dir)), jan, params, state, ckpt)
    assert read_alerts(spark, state).first()["duration_months"] == 1
    # and a correction of the target month itself removes the alert
    write_rows(feed_dir / "f2.parquet", [row("a1", "A", "AMER", jan, "Healthy", dt.datetime(2026, 1, 20))])
    run_alert_stream(spark, read_feed(spark, str(feed_dir)), jan, params, state, ckpt)
    assert read_alerts(spark, state).count() == 0
    assert spark.read.parquet(f"{state}/alerts").select(F.max("version")).first()[0] == 2


def _feed_of(tmp_path, rows):
    feed = tmp_path / "feed"
    feed.mkdir(exist_ok=True)
    n = len(list(feed.iterdir()))
    write_rows(feed / f"f{n:03d}.parquet", rows)
    return str(feed)


def test_twenty_batches_cost_no_more_files_than_two(spark, tmp_path, params):
    state, ckpt = str(tmp_path / "state"), str(tmp_path / "ckpt")
    for i in range(20):
        feed = _feed_of(tmp_path, [row(f"acc{k}", "N", "AMER", TARGET, "At Risk", dt.datetime(2024, 3, 1 + i)) for k in range(6)])
    run_alert_stream(spark, read_feed(spark, feed, 1), TARGET, params, state, ckpt, state_buckets=4)
    assert spark.read.parquet(f"{state}/latest").select("version").distinct().count() == 2
    assert spark.read.parquet(f"{state}/latest").where("version = 19").count() == 6
    assert read_alerts(spark, state).count() == 6


def test_restart_with_empty_top_buckets(spark, tmp_path, params):
    """Three accounts in eight buckets: a restarted stream finds their earlier months."""
    state, ckpt = str(tmp_path / "state"), str(tmp_path / "ckpt")
    names = ["birch", "cedar", "fir"]
    feed = _feed_of(tmp_path, [row(a, "N", "AMER", dt.date(2024, 2, 1), "At Risk", None) for a in names])
    run_alert_stream(spark, read_feed(spark, feed), TARGET, params, state, ckpt)
    assert read_alerts(spark, state).count() == 0
    _feed_of(tmp_path, [row(a, "N", "AMER", TARGET, "At Risk", None) for a in names])
    run_alert_stream(spark, read_feed(spark, feed), TARGET, params, state, ckpt)
    assert {(r["account_id"], r["duration_months"]) for r in read_alerts(spark, state).collect()} == {(a, 2) for a in names}
    with pytest.raises(ValueError, match="8 buckets"):
        run_alert_stream(spark, read_feed(spark, feed), TARGET, params, state, ckpt, state_buckets=16)


def test_compacted_emissions_go_on(spark, tmp_path):
    out, compacted, ckpt = (str(tmp_path / n) for n in ("out", "compacted", "ckpt"))
    feed = _feed_of(tmp_path, SAMPLE_ROWS[:13])
    run_latest_stream(spark, read_feed(spark, feed), out, ckpt)
    compact_latest(spark, out, compacted)
    _feed_of(tmp_path, SAMPLE_ROWS[13:])
    run_latest_stream(spark, read_feed(spark, feed), compacted, ckpt)
    want = latest_by_key(read_account_month(spark, feed)).collect()
    assert sorted(map(str, read_latest(spark, compacted).drop("n_versions").collect())) == sorted(map(str, want))


def test_rows_after_the_target_do_not_move_the_watermark(spark, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    feed = _feed_of(tmp_path, [row("fir", "F", "AMER", dt.date(2099, 1, 1), "At Risk", None)])
    _feed_of(tmp_path, [row("fir", "F", "AMER", TARGET, "At Risk", None)])
    _feed_of(tmp_path, [row("elm", "E", "AMER", TARGET, "At Risk", None)])
    q = run_latest_stream(spark, read_feed(spark, feed, 1), out, ckpt, watermark_months=2, target_month=TARGET)
    assert {r["account_id"] for r in read_latest(spark, out).collect()} == {"fir", "elm"}
    assert rejected_rows(q) == 1
    with pytest.raises(ValueError):
        latest_stream(read_feed(spark, feed), watermark_months=2)


def test_feed_without_a_column(spark, tmp_path, params):
    whole = _feed_of(tmp_path, SAMPLE_ROWS)
    contract = FeedContract(spark, whole)
    contract.check()
    schema = pa.schema([f for f in ARROW_SCHEMA if f.name != "arr"])
    pq.write_table(pa.Table.from_pylist([{k: v for k, v in SAMPLE_ROWS[0].items() if k != "arr"}], schema=schema), f"{whole}/late.parquet")
    with pytest.raises(SourceContractError):
        contract.check()
    with pytest.raises(SourceContractError):
        read_feed(spark, whole)


def test_stream_with_a_ledger_needs_a_transport(spark, tmp_path, params):
    feed = _feed_of(tmp_path, SAMPLE_ROWS)
    with pytest.raises(ValueError, match="transport"):
        run_alert_stream(spark, read_feed(spark, feed), TARGET, params, str(tmp_path / "s"), str(tmp_path / "c"), ledger_dir=str(tmp_path / "l"))


def test_stream_alerting_posts_each_alert_once(spark, tmp_path, params):
    from acct_health.operators.ledger import current_outcomes, read_log, read_runs
    from tests.conftest import FakeTransport, posts
    feed_dir = tmp_path / "feed"
    feed_dir.mkdir()
    jan, dec = dt.date(2026, 1, 1), dt.date(2025, 12, 1)
    write_rows(feed_dir / "f0.parquet", [row("a1", "A", "AMER", dec, "At Risk", dt.datetime(2025, 12, 2)),
                                         row("a1", "A", "AMER", jan, "At Risk", dt.datetime(2026, 1, 2)),
                                         row("a3", "C", None, jan, "At Risk", dt.datetime(2026, 1, 2))])
    state, ckpt, ledger = str(tmp_path / "state"), str(tmp_path / "ckpt"), str(tmp_path / "ledger")
    tr = FakeTransport(200, str(tmp_path))

    def run():
        run_alert_stream(spark, read_feed(spark, str(feed_dir)), jan, params, state, ckpt,
                         ledger_dir=ledger, transport=tr, sleep=lambda s: None)

    run()
    assert [p.split()[-1] for p in posts(str(tmp_path))] == ["at_risk|a1|2026-01-01"]
    # a later update of a1 (still at risk) posts nothing; a new account is sent
    write_rows(feed_dir / "f1.parquet", [row("a1", "A", "AMER", jan, "At Risk", dt.datetime(2026, 1, 20), arr=1),
                                         row("a2", "B", "EMEA", jan, "At Risk", dt.datetime(2026, 1, 20))])
    run()
    assert sorted(p.split()[-1] for p in posts(str(tmp_path))) == ["at_risk|a1|2026-01-01", "at_risk|a2|2026-01-01"]
    cur = {r["account_id"]: (r["status"], r["reason"]) for r in current_outcomes(read_log(spark, ledger)).collect()}
    assert cur == {"a1": ("sent", None), "a2": ("sent", None), "a3": ("failed", "unknown_region")}
    runs = read_runs(spark, ledger).orderBy("seq").collect()
    assert [(r["alerts_sent"], r["skipped_replay"], r["failed_deliveries"]) for r in runs] == [(1, 0, 1), (1, 1, 0)]
    digests = spark.read.parquet(f"{ledger}/digests").collect()
    assert len(digests) == 1 and digests[0]["run_id"] == runs[0]["id"] and "a3 (C) region=None" in digests[0]["body"]


def test_twenty_batches_of_the_latest_state_cost_no_more_than_two(spark, tmp_path):
    from acct_health.streaming.stream import read_latest_state, run_latest_state
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for i in range(20):
        feed = _feed_of(tmp_path, [row(f"acc{k}", "N", "AMER", TARGET, "At Risk", dt.datetime(2024, 3, 1 + i)) for k in range(6)])
    run_latest_state(spark, read_feed(spark, feed, 1), out, ckpt, state_buckets=4)
    versions = spark.read.parquet(f"{out}/latest").where("not mark")
    assert versions.select("version").distinct().count() == 2 and versions.where("version = 19").count() == 6
    assert len(read_latest_state(spark, out).inputFiles()) <= 4
    assert {(r["updated_at"].day, r["n_versions"]) for r in read_latest_state(spark, out).collect()} == {(20, 20)}


def test_late_rows_are_kept_and_old_months_closed(spark, tmp_path):
    from acct_health.streaming.stream import read_late_rows, read_latest_state, run_latest_state
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    month = lambda m: dt.date(2024, m, 1)
    batches = [[row("a", "A", "AMER", month(1), "At Risk", None), row("b", "B", "AMER", None, "At Risk", None)],
               [row("a", "A", "AMER", month(6), "Healthy", None), row("c", "C", "AMER", dt.date(2099, 1, 1), "Healthy", None)],
               [row("a", "A", "AMER", month(1), "Churned", None), row("a", "A", "AMER", month(5), "Healthy", None),
                row("d", "D", "AMER", month(4), "Healthy", None), row("d", "D", "AMER", month(4), "Healthy", None)]]
    for b in batches:
        feed = _feed_of(tmp_path, b)
    for _ in range(2):  # the second start finds nothing new
        run_latest_state(spark, read_feed(spark, feed, 1), out, ckpt, watermark_months=2, target_month=month(6), state_buckets=2)
    late = sorted((r["account_id"], r["month"].month, r["status"]) for r in read_late_rows(spark, out).collect())
    assert late == [("a", 1, "Churned")]
    state = {(r["account_id"], r["month"] and r["month"].month): r["n_versions"] for r in read_latest_state(spark, out).collect()}
    assert state == {("a", 1): 1, ("a", 5): 1, ("a", 6): 1, ("b", None): 1, ("d", 4): 2}
    assert sum(state.values()) + len(late) + 1 == sum(map(len, batches))  # one row is after the target
    live = spark.read.parquet(f"{out}/latest").where("not mark and month = '2024-01-01'")
    assert live.where("version = 2").count() == 0  # January is closed
    with pytest.raises(ValueError):
        run_latest_state(spark, read_feed(spark, feed), out, ckpt, watermark_months=2)
