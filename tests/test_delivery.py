"""Delivery retry/backoff against fake transports, the closed form, and message text."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from acct_health.functions.backoff import py_backoff
from acct_health.functions.render import message_text, payload_json
from acct_health.operators.delivery import RetryPolicy, Request, resolve_attempts, send_with_retry, target_url


def _seq(*responses):
    it = iter(responses)

    def transport(req: Request):
        r = next(it)
        if isinstance(r, Exception):
            raise r
        return r
    return transport


def _send(*responses, policy=None):
    """(result, pauses) of one alert answered by ``responses``."""
    pauses = []
    res = send_with_retry(_seq(*responses), "http://x", "{}", "some-key", {}, policy or RetryPolicy(), pauses.append)
    return res, pauses


@pytest.mark.parametrize("header", ["Retry-After", "retry-after", "RETRY-AFTER"])
def test_wait_named_by_the_receiver(header):
    res, pauses = _send((503, {header: "7"}), (201, {}))
    assert pauses == [7.0] and (res["ok"], res["status_code"], res["attempts"], res["waited_seconds"]) == (True, 201, 2, 7.0)


@pytest.mark.parametrize("last, error", [((500, {}), "HTTP 500"), ((429, None), "HTTP 429"), (OSError("line cut"), "line cut")])
def test_gives_up_after_the_policy_s_attempts(last, error):
    res, pauses = _send((502, {}), (503, {}), last, policy=RetryPolicy(max_attempts=3))
    assert (res["ok"], res["attempts"], res["error"], len(pauses)) == (False, 3, error, 2)
    assert res["status_code"] == (503 if isinstance(last, Exception) else last[0])


@pytest.mark.parametrize("status", [301, 400, 404, 422, 600])
def test_answers_that_waiting_can_t_change(status):
    res, pauses = _send((status, {"Retry-After": "1"}))
    assert pauses == [] and res["error"] == f"HTTP {status} (non-retryable)" and res["attempts"] == 1


def test_cut_line_then_accepted():
    res, pauses = _send(TimeoutError(), ConnectionError("reset"), (204, {}))
    assert res["ok"] and res["attempts"] == 3 and len(pauses) == 2


def test_jitter_stays_within_one_base():
    for n in range(50):
        pauses = []
        send_with_retry(lambda r: (503, {}), "u", "{}", f"key-{n}", {}, RetryPolicy(5, 2.0, 9.0), pauses.append)
        assert all(low <= p < low + 2.0 for p, low in zip(pauses, [2.0, 4.0, 8.0, 9.0], strict=True))


def test_policy_without_attempts():
    assert _send(policy=RetryPolicy(max_attempts=0))[0]["attempts"] == 0


def test_malformed_retry_after_uses_exponential():
    rng = None
    assert py_backoff(3, "soon", 1.0, 60.0, rng) == 8.0
    assert py_backoff(3, "-1", 1.0, 60.0, rng) == 8.0
    assert py_backoff(3, "nan", 1.0, 60.0, rng) == 8.0
    assert py_backoff(10, None, 1.0, 60.0, rng) == 60.0
    assert py_backoff(0, "7", 1.0, 60.0, rng) == 7.0


def test_target_urls(spark):
    df = spark.createDataFrame([("east-desk",)], "channel string")
    url = lambda base, single: df.select(target_url("channel", base, single).alias("u")).first()["u"]
    assert url("https://hub.example.org/in/", "https://hub.example.org/all") == "https://hub.example.org/in/east-desk"
    assert url(None, "https://hub.example.org/all") == "https://hub.example.org/all"
    with pytest.raises(ValueError):
        target_url("channel", "", None)


def test_closed_form_equals_the_loop(spark):
    rng = random.Random(7)
    statuses = [200, 201, 404, 400, 429, 500, 503, 502]
    rows, expect = [], {}
    for k in range(200):
        n = 5
        seq = [(rng.choice(statuses), rng.choice([None, "3", "soon", "0"])) for _ in range(n)]
        for i, (s, ra) in enumerate(seq):
            rows.append((k, i, s, ra))
        waits = []
        res = send_with_retry(_seq(*[(s, {} if ra is None else {"Retry-After": ra}) for s, ra in seq]),
                              "u", "{}", str(k), {}, RetryPolicy(jitter=False), waits.append)
        expect[k] = (res["ok"], res["status_code"], res["attempts"], res["error"], sum(waits))
    att = spark.createDataFrame(rows, "user_id long, attempt_no long, status int, retry_after string")
    got = {r["user_id"]: (r["ok"], r["status_code"], r["attempts"], r["error"], r["planned_wait_seconds"])
           for r in resolve_attempts(att, RetryPolicy(jitter=False)).collect()}
    assert got == expect


def test_whole_message(spark):
    df = spark.createDataFrame([("cedar", "Cedar Ltd", "APAC", dt.date(2024, 11, 30), "desk@example.org", 1_072_500, 5, dt.date(2023, 11, 1))],
                               "account_id string, account_name string, account_region string, renewal_date date, "
                               "account_owner string, arr long, duration_months long, risk_start_month date")
    message = message_text(base_url="https://crm.example.org/a").alias("m")
    assert df.select(message).first()["m"].split("\n") == [
        "\U0001F6A9 At Risk: Cedar Ltd (cedar)", "Region: APAC", "At Risk for: 5 months (since 2023-11-01)", "ARR: $1,072,500",
        "Renewal date: 2024-11-30", "Owner: desk@example.org", "Details: https://crm.example.org/a/cedar"]
    payload = df.select(message).select(payload_json("m")).first()["payload"]
    assert json.loads(payload) == {"text": df.select(message).first()["m"]}


def test_message_nulls_follow_python_formatting(spark):
    row = [("a9", None, None, None, "", None, 1, dt.date(2026, 1, 1))]
    df = spark.createDataFrame(row, "account_id string, account_name string, account_region string, "
                                    "renewal_date date, account_owner string, arr long, duration_months long, "
                                    "risk_start_month date")
    text = df.select(message_text(base_url="b")).first()["message"]
    assert text.split("\n") == ["\U0001F6A9 At Risk: None (a9)", "Region: None",
                                "At Risk for: 1 months (since 2026-01-01)", "ARR: Unknown",
                                "Renewal date: Unknown", "Details: b/a9"]
    neg = spark.createDataFrame([(-1500,), (0,), (2 ** 60,)], "arr long")
    from acct_health.functions.render import arr_text
    assert [r[0] for r in neg.select(arr_text()).collect()] == ["$-1,500", "$0", f"${2 ** 60:,}"]


def test_short_attempt_log_counts_missing_attempts_as_transport_errors(spark):
    from acct_health.operators.delivery import NO_RESPONSE, replay_transport
    att = spark.createDataFrame([(1, 0, 503, None), (1, 1, 429, "2"), (2, 0, 404, None)],
                                "user_id long, attempt_no long, status int, retry_after string")
    got = {r["user_id"]: r for r in resolve_attempts(att, RetryPolicy(jitter=False)).collect()}
    assert (got[1]["ok"], got[1]["status_code"], got[1]["attempts"], got[1]["error"]) == (False, 429, 5, NO_RESPONSE)
    assert got[1]["planned_wait_seconds"] == 1.0 + 2.0 + 4.0 + 8.0 - 2.0 + 2.0  # 1, RA 2, 4, 8
    assert (got[2]["attempts"], got[2]["error"]) == (1, "HTTP 404 (non-retryable)")
    waits = []
    res = send_with_retry(replay_transport("r"), "u", "{}", "k",
                          {"r": [{"status": 503, "retry_after": None}, {"status": 429, "retry_after": "2"}]},
                          RetryPolicy(jitter=False), waits.append)
    assert (res["ok"], res["status_code"], res["attempts"], res["error"]) == (False, 429, 5, NO_RESPONSE)
    assert sum(waits) == got[1]["planned_wait_seconds"]


def test_retry_after_parsing_matches_python(spark):
    from pyspark.sql import functions as F

    from acct_health.functions.backoff import py_retry_after, retry_after_seconds
    vals = ["2", " 2 ", "2.5", ".5", "5.", "+3", "-1", "1e3", "1E3", "inf", "Infinity", "nan", "1_000",
            "1__000", "_1", "1_", "0x10", "0x1p3", "", " ", "soon", "3 s", "\t4\n", "1,5", "007", "1d", "2f",
            "1e999", "1e1_0", None]
    df = spark.createDataFrame([(v,) for v in vals], "r string")
    got = [r[0] for r in df.select(retry_after_seconds(F.col("r"))).collect()]
    assert got == [py_retry_after(v) for v in vals]


def test_classes_and_backoff_match_the_loop(spark):
    from pyspark.sql import functions as F

    from acct_health.functions.backoff import backoff_seconds, py_backoff, py_classify, response_class
    statuses = [None] + list(range(100, 700))
    df = spark.createDataFrame([(s,) for s in statuses], "status int")
    got = [r[0] for r in df.select(response_class("status")).collect()]
    assert got == [py_classify(s) for s in statuses]
    grid = [(a, ra) for a in range(12) for ra in (None, "3", "soon", "-2", "0")]
    g = spark.createDataFrame(grid, "attempt_no long, retry_after string")
    waits = [r[0] for r in g.select(backoff_seconds("attempt_no", "retry_after", 1.5, 40.0)).collect()]
    assert waits == [py_backoff(a, ra, 1.5, 40.0, None) for a, ra in grid]
