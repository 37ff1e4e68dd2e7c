"""Command line: ``python -m acct_health {preview,run,status} ...``; prints JSON.

preview  alerts and counts for a month (no sends, nothing stored): all alerts go to ``--out`` as
         Parquet, the counts to stdout. Without ``--out`` only the counts are made.
backfill preview alerts of every month in one pass, written to ``--out`` (Parquet by month);
         stdout shows the number of alerts per month.
run      a real (or ``--dry-run``) run into a ledger folder; prints the run id.
status   a run's counts and samples.
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt
import json
import sys

from acct_health.params import Params, parse_region_map


def _params(a) -> Params:
    p = Params(arr_threshold=a.arr_threshold, lookback_months=a.lookback,
               details_base_url=a.details_base_url.rstrip("/"),
               webhook_base_url=getattr(a, "webhook_base_url", None) or None,
               webhook_url=getattr(a, "webhook_url", None) or None,
               tie_break=a.tie_break, support_email=getattr(a, "support_email", None))
    if a.region_map:
        p = dataclasses.replace(p, region_channel_map=parse_region_map(a.region_map))
    if getattr(a, "max_attempts", None) is not None:
        p = dataclasses.replace(p, retry_max_attempts=a.max_attempts, retry_base_seconds=a.retry_base,
                                retry_cap_seconds=a.retry_cap)
    return p


def _source(spark, a):
    from acct_health.sources.account_month import read_account_month

    return read_account_month(spark, a.source, scan_position=a.tie_break == "scan_order")


def _json(obj) -> str:
    return json.dumps(obj, default=lambda o: o.isoformat() if isinstance(o, (dt.date, dt.datetime)) else str(o),
                      ensure_ascii=False)


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="acct_health")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("preview", "run", "backfill"):
        s = sub.add_parser(name)
        s.add_argument("--source", required=True)
        if name == "backfill":
            s.add_argument("--from-month", default=None)
            s.add_argument("--to-month", default=None)
            s.add_argument("--out", required=True)
        else:
            s.add_argument("--month", required=True)
        s.add_argument("--arr-threshold", type=int, default=0)
        s.add_argument("--lookback", type=int, default=24)
        s.add_argument("--region-map", default=None, help='JSON: {"AMER": "..."} or {"regions": {...}}')
        s.add_argument("--details-base-url", default=Params().details_base_url)
        s.add_argument("--tie-break", choices=["columns", "scan_order"], default=Params().tie_break,
                       help="which of a month's rows with equal updated_at counts: by the other columns, or the last scanned")
    pv = sub.choices["preview"]
    pv.add_argument("--out", default=None)
    rn = sub.choices["run"]
    rn.add_argument("--ledger", required=True)
    rn.add_argument("--webhook-base-url", default=None)
    rn.add_argument("--webhook-url", default=None)
    rn.add_argument("--dry-run", action="store_true")
    rn.add_argument("--support-email", default=None, help="recipient of the digest of unroutable accounts")
    rn.add_argument("--max-attempts", type=int, default=Params().retry_max_attempts)
    rn.add_argument("--retry-base", type=float, default=Params().retry_base_seconds)
    rn.add_argument("--retry-cap", type=float, default=Params().retry_cap_seconds)
    st = sub.add_parser("status")
    st.add_argument("--ledger", required=True)
    st.add_argument("--run-id", required=True)
    for s in sub.choices.values():
        s.add_argument("--master", default=None)
    a = ap.parse_args(argv)

    from acct_health.session import get_spark
    spark = get_spark(a.master)
    if a.cmd == "preview":
        from acct_health.plans.alerts import preview
        alerts, counts = preview(spark, _source(spark, a), a.month, _params(a), materialize=bool(a.out))
        if a.out:
            alerts.write.mode("overwrite").parquet(a.out)
        print(_json(counts.first().asDict() | ({"out": a.out} if a.out else {})))
    elif a.cmd == "backfill":
        from pyspark.sql import functions as F

        from acct_health.plans.alerts import backfill_alerts
        alerts = backfill_alerts(spark, _source(spark, a), _params(a), a.from_month, a.to_month)
        alerts.write.mode("overwrite").partitionBy("month").parquet(a.out)
        per_month = (spark.read.parquet(a.out).groupBy("month").agg(F.count(F.lit(1)).alias("alerts"))
                     .orderBy("month").collect())  # one row per month
        print(_json({"out": a.out, "alerts_per_month": {str(r["month"]): r["alerts"] for r in per_month}}))
    elif a.cmd == "run":
        from acct_health.operators.delivery import http_transport
        from acct_health.plans.run import run_month
        print(_json({"run_id": run_month(spark, a.source, a.month, a.ledger, _params(a),
                                         transport=http_transport(), dry_run=a.dry_run)}))
    else:
        from acct_health.plans.run import run_status
        st = run_status(spark, a.ledger, a.run_id)
        if st is None:
            print(_json({"error": "run not found"}))
            return 1
        print(_json(st))
    return 0


if __name__ == "__main__":
    sys.exit(main())
