"""Latest row per key: newest updated_at wins, duplicates counted, ties deterministic."""

from __future__ import annotations

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from acct_health.operators.dedup import dedup_counts, deduplicate, latest_by_key
from acct_health.sources.account_month import ACCOUNT_MONTH_SCHEMA, month_window, read_account_month
from tests.conftest import ARROW_SCHEMA, SAMPLE_ROWS, TARGET, row, write_rows


def _row(account_id, month, status, updated_at, **kw):
    return row(account_id, "Any", "EMEA", month, status, updated_at, arr=1, renewal_date=None, account_owner=None) | kw


def _df(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ACCOUNT_MONTH_SCHEMA.names) for r in rows], ACCOUNT_MONTH_SCHEMA)


def test_versions_of_a_month_become_the_latest(spark):
    versions = [_row("oak", dt.date(2023, 7, 1), s, dt.datetime(2023, 7, d)) for d, s in [(9, "Churned"), (28, "At Risk"), (14, "Healthy")]]
    other = [_row("oak", dt.date(2023, 8, 1), "Healthy", None), _row("yew", dt.date(2023, 7, 1), "Churned", dt.datetime(2023, 7, 1))]
    latest, dup = deduplicate(_df(spark, versions + other))
    assert dup.first()["duplicate_rows"] == 2
    got = {(r["account_id"], r["month"].month): (r["status"], r["updated_at"]) for r in latest.collect()}
    assert got == {("oak", 7): ("At Risk", dt.datetime(2023, 7, 28)), ("oak", 8): ("Healthy", None),
                   ("yew", 7): ("Churned", dt.datetime(2023, 7, 1))}


def test_no_rows(spark):
    latest, dup = deduplicate(spark.createDataFrame([], ACCOUNT_MONTH_SCHEMA))
    assert latest.columns == ACCOUNT_MONTH_SCHEMA.names
    assert (latest.count(), dup.first()["duplicate_rows"]) == (0, 0)


def test_null_never_beats_a_value_and_ties_are_deterministic(spark):
    m = dt.date(2026, 1, 1)
    t = dt.datetime(2026, 1, 3)
    rows = [
        _row("a1", m, "Healthy", None),
        _row("a1", m, "Churned", t),
        _row("a1", m, "At Risk", t),          # tie on updated_at: smallest status wins
        _row("a2", m, "Healthy", None),
        _row("a2", m, "At Risk", None),       # all null: smallest status wins
    ]
    for seed in range(3):  # input order must not matter
        random.Random(seed).shuffle(rows)
        by_id = {r["account_id"]: r for r in latest_by_key(_df(spark, rows).repartition(3)).collect()}
        assert by_id["a1"]["status"] == "At Risk" and by_id["a1"]["updated_at"] == t
        assert by_id["a2"]["status"] == "At Risk"


def test_versions_in_different_files(spark, tmp_path):
    folder = tmp_path / "split"
    folder.mkdir()
    for i, r in enumerate(SAMPLE_ROWS):  # a file for every row
        write_rows(folder / f"part-{i:02d}.parquet", [r])
    win = month_window(read_account_month(spark, f"file://{folder}"), TARGET, 24)
    c = dedup_counts(win).first()
    assert (c["rows_scanned"], c["duplicate_rows"]) == (16, 2)
    assert {r["status"] for r in latest_by_key(win).where("account_id = 'elm'").collect()} == {"Healthy"}


def test_window_bounds_are_inclusive(spark):
    rows = [_row("a1", dt.date(2023, 12, 1), "At Risk", None),   # 25 months back: out
            _row("a1", dt.date(2024, 1, 1), "At Risk", None),    # 24 back: in
            _row("a1", dt.date(2026, 1, 1), "At Risk", None),    # target: in
            _row("a1", dt.date(2026, 2, 1), "At Risk", None)]    # after target: out
    got = sorted(r["month"] for r in month_window(_df(spark, rows), "2026-01-01", 24).collect())
    assert got == [dt.date(2024, 1, 1), dt.date(2026, 1, 1)]


def test_nanosecond_timestamps(spark, tmp_path):
    schema = pa.schema([f if f.name != "updated_at" else pa.field("updated_at", pa.timestamp("ns"))
                        for f in ARROW_SCHEMA])
    path = write_rows(tmp_path / "ns.parquet", SAMPLE_ROWS, schema)
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        am = read_account_month(spark, path)
        assert dict(am.dtypes)["updated_at"] == "timestamp_ntz"
        latest = {(r["account_id"], r["month"]): r for r in latest_by_key(am).collect()}
        assert latest[("elm", TARGET)]["status"] == "Healthy"
    finally:
        spark.conf.unset("spark.sql.legacy.parquet.nanosAsLong")


def test_missing_column_is_a_contract_error(spark, tmp_path):
    from acct_health.sources.account_month import SourceContractError
    t = pa.Table.from_pylist([{"account_id": "a1", "month": dt.date(2026, 1, 1)}])
    pq.write_table(t, str(tmp_path / "bad.parquet"))
    with pytest.raises(SourceContractError):
        read_account_month(spark, str(tmp_path / "bad.parquet"))


def test_utc_adjusted_timestamps_keep_their_order_in_any_session_zone(spark, tmp_path):
    # two instants one hour apart that share one Los Angeles wall time (fall-back overlap)
    schema = pa.schema([f if f.name != "updated_at" else pa.field("updated_at", pa.timestamp("us", tz="UTC"))
                        for f in ARROW_SCHEMA])
    t1, t2 = dt.datetime(2021, 11, 7, 8, 30), dt.datetime(2021, 11, 7, 9, 30)
    rows = [_row("a1", dt.date(2021, 11, 1), "Healthy", t1), _row("a1", dt.date(2021, 11, 1), "At Risk", t2)]
    path = write_rows(tmp_path / "utc.parquet", rows, schema)
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        am = read_account_month(spark, path)
        assert dict(am.dtypes)["updated_at"] == "timestamp_ntz"
        got = latest_by_key(am).first()
        assert got["status"] == "At Risk" and got["updated_at"] == t2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _scan_latest(spark, path):
    am = read_account_month(spark, path, scan_position=True)
    return {(r["account_id"], r["month"]): r["status"] for r in latest_by_key(am, tie_break="scan_order").collect()}


def test_scan_order_tie_break_within_a_file(spark, tmp_path):
    m, t = dt.date(2026, 1, 1), dt.datetime(2026, 1, 5)
    rows = [_row("k1", m, "At Risk", t), _row("k1", m, "Healthy", t),       # equal times: last scanned wins
            _row("k2", m, "Healthy", None), _row("k2", m, "At Risk", None),  # all null: first scanned wins
            _row("k3", m, "Churned", None), _row("k3", m, "Healthy", t), _row("k3", m, "At Risk", None)]
    path = write_rows(tmp_path / "ties.parquet", rows)
    got = _scan_latest(spark, path)
    assert got == {("k1", m): "Healthy", ("k2", m): "Healthy", ("k3", m): "Healthy"}
    by_columns = {r["account_id"]: r["status"] for r in latest_by_key(read_account_month(spark, path)).collect()}
    assert by_columns == {"k1": "At Risk", "k2": "At Risk", "k3": "Healthy"}


def test_scan_order_follows_file_path_order(spark, tmp_path):
    m, t = dt.date(2026, 1, 1), dt.datetime(2026, 1, 5)
    folder = tmp_path / "files"
    folder.mkdir()
    write_rows(folder / "b.parquet", [_row("k1", m, "At Risk", t), _row("k2", m, "At Risk", None)])
    write_rows(folder / "a.parquet", [_row("k1", m, "Healthy", t), _row("k2", m, "Healthy", None)])
    got = _scan_latest(spark, str(folder))
    assert got == {("k1", m): "At Risk", ("k2", m): "Healthy"}  # b scanned after a


def test_scan_order_requires_a_position(spark):
    with pytest.raises(ValueError):
        latest_by_key(spark.createDataFrame([], ACCOUNT_MONTH_SCHEMA), tie_break="scan_order")


def _fold(rows):
    """Plain fold in scan order: a null never replaces, a value replaces a null, >= replaces."""
    best = {}
    for r in rows:
        k = (r["account_id"], r["month"])
        cur = best.get(k)
        if cur is None:
            best[k] = r
        elif r["updated_at"] is not None and (cur["updated_at"] is None or r["updated_at"] >= cur["updated_at"]):
            best[k] = r
    return best


def _columns_rule(rows):
    """The documented default: updated_at desc nulls last, then the other columns asc nulls last."""
    cols = ["account_name", "account_region", "status", "renewal_date", "account_owner", "arr"]
    def key(r):
        t = r["updated_at"]
        return ((t is None, -(t - dt.datetime(1970, 1, 1)).total_seconds() if t else 0),
                *[(r[c] is None, r[c] if r[c] is not None else 0) for c in cols])
    best = {}
    for r in sorted(rows, key=key):
        best.setdefault((r["account_id"], r["month"]), r)
    return best


@pytest.mark.parametrize("seed", [3, 11])
def test_dedup_rules_against_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    months = [dt.date(2026, m, 1) for m in (1, 2)]
    times = [None, dt.datetime(2026, 1, 3), dt.datetime(2026, 1, 4)]
    rows = [_row(f"k{rng.randrange(6)}", rng.choice(months), rng.choice(["At Risk", "Healthy", "Churned"]),
                 rng.choice(times), arr=rng.choice([None, 1, 2]), account_owner=rng.choice([None, "", "o"]))
            for _ in range(400)]
    path = write_rows(tmp_path / f"rand{seed}.parquet", rows)
    pick = lambda d: {k: (v["status"], v["arr"], v["account_owner"], v["updated_at"]) for k, v in d.items()}
    got_scan = latest_by_key(read_account_month(spark, path, scan_position=True), tie_break="scan_order")
    assert pick({(r["account_id"], r["month"]): r for r in got_scan.collect()}) == pick(_fold(rows))
    got_cols = latest_by_key(read_account_month(spark, path).repartition(4))
    assert pick({(r["account_id"], r["month"]): r for r in got_cols.collect()}) == pick(_columns_rule(rows))
