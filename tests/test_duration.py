"""Continuous At-Risk duration: both streak plans against patterns and a plain walk."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from acct_health.functions.months import month_minus
from tests.conftest import TARGET
from acct_health.operators.streak import streak_to, streak_to_ranked, streaks_all

AR, H = "At Risk", "Healthy"


def _latest(spark, history, account="a1"):
    return spark.createDataFrame([(account, m, s) for m, s in history.items()],
                                 "account_id string, month date, status string")


def _both(spark, history, target, lookback=24):
    out = []
    for fn in (streak_to, streak_to_ranked):
        r = fn(_latest(spark, history), target, lookback).first()
        out.append((r["duration_months"], r["risk_start_month"]))
    assert out[0] == out[1]
    return out[0]


def _months(target, pattern):
    """Months back from the target by a pattern: R at risk, h healthy, . no row."""
    return {month_minus(target, k): {"R": AR, "h": H}[c] for k, c in enumerate(pattern) if c != "."}


@pytest.mark.parametrize("pattern, months", [
    ("R", 1), ("RRRR", 4), ("RRhRRR", 2), ("RRR.RRRR", 3), ("R.", 1), ("hRRR", 1), (".RRR", 1), ("R" * 14 + "h", 14)])
def test_streak_patterns(spark, pattern, months):
    target = dt.date(2021, 2, 1)  # a month early in its year, so streaks cross the turn of the year
    history = _months(target, pattern) or {month_minus(target, 40): H}
    assert _both(spark, history, target) == (months, month_minus(target, months - 1))


def test_mid_month_date_is_never_visited(spark):
    h = {dt.date(2021, 1, 17): AR, dt.date(2021, 2, 1): AR}
    assert _both(spark, h, dt.date(2021, 2, 1)) == (1, dt.date(2021, 2, 1))


def test_account_without_an_id_has_its_streak_in_both_plans(spark):
    target = dt.date(2021, 2, 1)
    rows = [(None, month_minus(target, k), AR) for k in range(3)]
    df = spark.createDataFrame(rows, "account_id string, month date, status string")
    assert [fn(df, target, 24).first()["duration_months"] for fn in (streak_to, streak_to_ranked)] == [3, 3]


def _walk(history, target, lookback):
    d, cur = 0, target
    while history.get(cur) == AR and d <= lookback:
        d += 1
        cur = month_minus(cur, 1)
    return max(d, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_plans_equal_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    target = dt.date(2026, 1, 1)
    rows, expect, expect_all = [], {}, {}
    for a in range(60):
        hist = {}
        for k in range(30):
            if rng.random() < 0.85:
                hist[month_minus(target, k)] = AR if rng.random() < 0.8 else H
        for m, s in hist.items():
            rows.append((f"a{a}", m, s))
        expect[f"a{a}"] = _walk({m: s for m, s in hist.items() if m >= month_minus(target, 24)}, target, 24)
        for m, s in hist.items():
            if s == AR:
                expect_all[(f"a{a}", m)] = min(_walk(hist, m, 10 ** 6), 25)
    df = spark.createDataFrame(rows, "account_id string, month date, status string")
    win = df.where(df.month >= month_minus(target, 24))
    for fn in (streak_to, streak_to_ranked):
        got = {r["account_id"]: r["duration_months"] for r in fn(win, target, 24).collect()}
        assert got == expect
    got_all = {(r["account_id"], r["month"]): r["duration_months"] for r in streaks_all(df, 24).collect()}
    assert got_all == expect_all


@pytest.mark.parametrize("length", [61, 62, 63, 70, 124, 125, 130])
def test_lookbacks_of_several_masks(spark, length):
    target = dt.date(2026, 1, 1)
    h = {month_minus(target, k): AR for k in range(length)} | {month_minus(target, length + 1): AR}
    assert _both(spark, h, target, 200)[0] == length
    assert _both(spark, h, target, 62)[0] == min(length, 63)


def test_truncation_flag(spark):
    target = dt.date(2026, 1, 1)
    h = {month_minus(target, k): AR for k in range(5)}
    r = streak_to(_latest(spark, h), target, 2, with_truncation=True).first()
    assert (r["duration_months"], r["is_truncated"]) == (3, True)
    r = streak_to(_latest(spark, h), target, 24, with_truncation=True).first()
    assert (r["duration_months"], r["is_truncated"]) == (5, False)


def test_load_and_deduplicate(spark, sample_parquet):
    from acct_health.operators.dedup import load_and_deduplicate
    latest, counts = load_and_deduplicate(spark, sample_parquet, TARGET, 24)
    c = counts.first()
    assert (c["rows_scanned"], c["duplicate_rows"]) == (16, 2)
    assert latest.count() == 14
