"""Feeds and scans that the queries write themselves: micro-batches and files follow the values and the rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from acct_health.plans import registry
from acct_health.sources.account_month import ACCOUNT_MONTH_SCHEMA
from acct_health.streaming.stream import read_late_rows, read_latest_state, run_latest_state


def _rows(spark, counts):
    """Account months of the years in ``counts``, over more partitions than there are years."""
    rows = [(f"a{i}", "N", "AMER", year and dt.date(year, 1 + i % 12, 1), "At Risk", None, None, i, None) for year, n in counts for i in range(n)]
    return spark.createDataFrame(rows, ACCOUNT_MONTH_SCHEMA).repartition(7)


def test_a_year_of_an_ordered_feed_is_one_micro_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "_am", lambda *_: _rows(spark, [(2024, 1), (2023, 2), (2020, 50), (2019, 9), (None, 3)]))
    monkeypatch.setattr(registry, "FEED_FILE_ROWS", 10)
    out, ckpt = str(tmp_path / "out"), tmp_path / "ckpt"
    feed = registry._feed(spark, "", order=-F.year("month"))
    run_latest_state(spark, feed, out, str(ckpt), 24, dt.date(2024, 6, 1), state_buckets=2)
    assert len([p for p in (ckpt / "commits").iterdir() if p.name.isdigit()]) == 4
    years = lambda df, n: {r[0]: r[1] for r in df.groupBy(F.year("month")).agg(n).collect()}
    assert years(read_latest_state(spark, out), F.sum("n_versions")) == {2024: 1, 2023: 2}
    assert years(read_late_rows(spark, out), F.count("*")) == {2020: 50, 2019: 9}


def test_a_feed_without_rows(spark, monkeypatch):
    monkeypatch.setattr(registry, "_am", lambda *_: _rows(spark, [(None, 3)]))
    assert registry._feed(spark, "", order=F.year("month")).isStreaming


def test_scan_order_files_follow_the_rows(spark, monkeypatch):
    place = [F.col("arr").alias("l_orderkey"), (F.col("arr") % 7).alias("l_linenumber")]
    rows = _rows(spark, [(1998, 400), (1997, 400)]).select("*", *place)
    monkeypatch.setattr(registry, "account_month_from_tables", lambda *_, **__: rows)
    monkeypatch.setattr(registry, "FEED_FILE_ROWS", 20)
    got = registry.q_dedup_scan_order(spark, "")
    files = [f for f in got.inputFiles() if "/scan-" in f]
    assert len(files) > 30 and max(spark.read.parquet(f).count() for f in files) <= 80
    first = {}  # no row has an update time: the first in the scan wins
    for i in range(400):
        for year in (1998, 1997):
            if (1996, 6) <= (year, 1 + i % 12) <= (1998, 6):
                first.setdefault((f"a{i}", dt.date(year, 1 + i % 12, 1)), i)
    assert {(r["account_id"], r["month"]): r["arr"] for r in got.collect()} == first
