"""Entry-point surface: URI schemes, month validation, waves, digest parts, CLI, watermark."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from acct_health.operators.digest import digest_lines, unknown_region_digest
from acct_health.operators.ledger import current_outcomes, read_log
from acct_health.plans.run import delivery_layout, run_month, run_status
from acct_health.params import Params
from acct_health.sources.account_month import validate_month
from acct_health.sources.uri import resolve_uri
from tests.conftest import TARGET, FakeTransport, posts, row, write_rows


def test_uri_schemes():
    assert resolve_uri("/data/x.parquet") == "/data/x.parquet"
    assert resolve_uri("file:///data/x.parquet") == "file:///data/x.parquet"
    assert resolve_uri("file://host/data/x.parquet") == "file:///data/x.parquet"
    assert resolve_uri("gs://b/k.parquet") == "gs://b/k.parquet"
    assert resolve_uri("s3://b/k.parquet") == "s3a://b/k.parquet"
    with pytest.raises(ValueError):
        resolve_uri("ftp://h/x")


def test_month_validation():
    assert validate_month("2026-01-01") == dt.date(2026, 1, 1)
    assert validate_month(dt.date(2026, 1, 1)) == dt.date(2026, 1, 1)
    for bad in ["2026-01-15", "20260101", "2026-W01-4", "2026-1-1", "2026-02-30"]:
        with pytest.raises(ValueError):
            validate_month(bad)


def test_delivery_layout():
    p = Params()
    assert delivery_layout(0, p) == (1, 1)
    assert delivery_layout(1000, p) == (5, 1)
    assert delivery_layout(10 ** 6, p) == (250, 20)
    assert delivery_layout(10, dataclasses.replace(p, delivery_partitions=3, delivery_waves=2)) == (3, 2)


def test_waves_send_each_alert_once(spark, sample_parquet, params, tmp_path):
    ledger = str(tmp_path / "ledger")
    waved = dataclasses.replace(params, delivery_waves=3)
    rid = run_month(spark, sample_parquet, TARGET, ledger, waved, transport=FakeTransport(200, str(tmp_path)),
                    sleep=lambda s: None)
    assert run_status(spark, ledger, rid)["counts"]["alerts_sent"] == 2
    assert sorted(p.split()[-1] for p in posts(str(tmp_path))) == ["at_risk|birch|2024-03-01", "at_risk|cedar|2024-03-01"]
    cur = current_outcomes(read_log(spark, ledger))
    assert cur.count() == cur.select("account_id", "month", "alert_type").distinct().count() == 4


def test_dry_run_writes_no_digest(spark, sample_parquet, params, tmp_path):
    ledger = str(tmp_path / "ledger")
    run_month(spark, sample_parquet, TARGET, ledger, params, transport=FakeTransport(200), dry_run=True)
    assert not os.path.exists(f"{ledger}/digests")


def test_digest_parts_cover_every_account_once(spark):
    rows = [(f"a{i:04d}", f"N{i}", None if i % 3 else "LATAM", False) for i in range(500)]
    routed = spark.createDataFrame(rows, "account_id string, account_name string, account_region string, routable boolean")
    one = unknown_region_digest(routed, "r1", 500).collect()
    assert len(one) == 1 and one[0]["n_accounts"] == 500
    lines = one[0]["body"].split("\n")[1:]
    assert lines == sorted(lines) and lines[0] == "  - a0000 (N0) region='LATAM'" and lines[1].endswith("region=None")
    parts = unknown_region_digest(routed, "r1", 500, parts=4).collect()
    assert len(parts) == 4 and all(p["n_accounts"] == 500 for p in parts)
    assert sum(p["n_lines"] for p in parts) == 500
    assert sorted(l for p in parts for l in p["body"].split("\n")[1:]) == sorted(lines)
    assert {r["line"] for r in digest_lines(routed, "r1").collect()} == set(lines)
    assert unknown_region_digest(routed.where("routable"), "r1", 0).count() == 0


def test_region_repr_quotes_like_python(spark):
    from acct_health.operators.digest import py_repr
    vals = ["AMER", "it's", 'say "hi"', "a'b\"c", "back\\slash", None]
    df = spark.createDataFrame([(v,) for v in vals], "r string")
    assert [r[0] for r in df.select(py_repr(F.col("r"))).collect()] == [repr(v) for v in vals]


@pytest.mark.parametrize("tie_break", ["columns", "scan_order"])
def test_cli_preview(sample_parquet, capsys, spark, tmp_path, tie_break):
    from acct_health.__main__ import main
    args = ["preview", "--source", sample_parquet, "--month", str(TARGET), "--tie-break", tie_break]
    assert main(args) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (out["at_risk_count"], out["unknown_region_count"]) == (4, 2) and "out" not in out
    assert main([*args, "--out", str(tmp_path / "alerts")]) == 0
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 4


def test_watermark_stream_on_month_ordered_feed(spark, tmp_path):
    from acct_health.streaming.stream import read_feed, read_latest, run_latest_stream
    feed = tmp_path / "feed"
    feed.mkdir()
    months = [dt.date(2025, m, 1) for m in range(1, 13)]
    for i, m in enumerate(months):  # month-ordered arrival, one month per file
        write_rows(feed / f"f{i:02d}.parquet", [row("a1", "A", "AMER", m, "At Risk", dt.datetime(m.year, m.month, 2)),
                                                row("a1", "A", "AMER", m, "Healthy", dt.datetime(m.year, m.month, 3))])
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    run_latest_stream(spark, read_feed(spark, str(feed), 1), out, ckpt, watermark_months=2, target_month=months[-1])
    got = {r["month"]: r["status"] for r in read_latest(spark, out).collect()}
    assert set(got) == set(months) and set(got.values()) == {"Healthy"}


def test_cli_dry_run_and_status(sample_parquet, capsys, spark, tmp_path):
    from acct_health.__main__ import main
    ledger = str(tmp_path / "ledger")
    assert main(["run", "--source", sample_parquet, "--month", str(TARGET), "--ledger", ledger, "--dry-run"]) == 0
    run_id = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["run_id"]
    assert main(["status", "--ledger", ledger, "--run-id", run_id]) == 0
    st = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert st["dry_run"] is True and st["counts"]["alerts_sent"] == 2 and st["counts"]["failed_deliveries"] == 2
    assert main(["status", "--ledger", ledger, "--run-id", "nope"]) == 1


def test_cli_backfill(sample_parquet, capsys, spark, tmp_path):
    from acct_health.__main__ import main
    out = str(tmp_path / "backfill")
    assert main(["backfill", "--source", sample_parquet, "--out", out]) == 0
    res = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    # birch Dec, Feb, Mar; cedar every month; dune and gum in March
    assert res["alerts_per_month"] == {"2023-11-01": 1, "2023-12-01": 2, "2024-01-01": 1, "2024-02-01": 2, "2024-03-01": 4}
