"""Independent SQL oracles (DuckDB dialect) for the registered queries.

Each string runs on the pre-registered views of the test tables. The derivations here are
written separately from the DataFrame code (ranks instead of bitmasks, ``row_number`` instead
of a struct maximum), so agreement checks the method, not just the wiring.
"""

from __future__ import annotations

# Account-month rows derived from the TPC-H-like tables (same mapping as sources.fixtures).
AM = """
SELECT concat('a', lpad(cast(l.l_suppkey AS varchar), cast(greatest(5, length(cast(l.l_suppkey AS varchar))) AS integer), '0')) AS account_id,
       s.s_name AS account_name,
       CASE r.r_name WHEN 'AMERICA' THEN 'AMER' WHEN 'EUROPE' THEN 'EMEA' WHEN 'ASIA' THEN 'APAC'
                     WHEN 'AFRICA' THEN 'AFRICA' ELSE NULL END AS account_region,
       {month_expr} AS month,
       CASE WHEN l.l_returnflag IN ('R','A') THEN 'At Risk'
            WHEN l.l_linestatus = 'O' THEN 'Healthy' ELSE 'Churned' END AS status,
       CASE WHEN l.l_linenumber % 3 = 0 THEN NULL ELSE cast(l.l_shipdate AS date) END AS renewal_date,
       CASE WHEN l.l_linenumber = 1 THEN NULL WHEN l.l_linenumber = 2 THEN ''
            ELSE concat('owner', cast(l.l_linenumber AS varchar), '@example.com') END AS account_owner,
       CASE WHEN l.l_quantity < 5 THEN NULL
            ELSE cast(floor(l.l_extendedprice) AS bigint) - 20000 END AS arr,
       CASE WHEN l.l_quantity = 50 THEN NULL ELSE l.l_shipdate END AS updated_at
FROM lineitem l
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""
# A supplier's rows of some months count for the month before.
COUNTED = """CASE WHEN (l.l_suppkey + month(l.l_shipdate)) % 11 = 0
                 THEN cast(l.l_shipdate AS date) - INTERVAL 1 MONTH ELSE l.l_shipdate END"""
AM_MONTH = AM.format(month_expr=f"cast(date_trunc('month', {COUNTED}) AS date)")
AM_RAW = AM.format(month_expr=f"cast({COUNTED} AS date)")

# Low-duplicate account months from orders (same mapping as sources.fixtures.account_month_from_orders).
AM_ORDERS = """
SELECT concat('c', lpad(cast(o.o_custkey AS varchar), cast(greatest(6, length(cast(o.o_custkey AS varchar))) AS integer), '0')) AS account_id,
       c.c_name AS account_name,
       CASE r.r_name WHEN 'AMERICA' THEN 'AMER' WHEN 'EUROPE' THEN 'EMEA' WHEN 'ASIA' THEN 'APAC'
                     WHEN 'AFRICA' THEN 'AFRICA' ELSE NULL END AS account_region,
       cast(date_trunc('month', o.o_orderdate) AS date) AS month,
       CASE o.o_orderstatus WHEN 'O' THEN 'At Risk' WHEN 'P' THEN 'Healthy' ELSE 'Churned' END AS status,
       cast(o.o_orderdate AS date) AS renewal_date,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN NULL WHEN o.o_orderpriority = '2-HIGH' THEN ''
            ELSE concat('owner', substr(o.o_orderpriority, 1, 1), '@example.com') END AS account_owner,
       cast(floor(o.o_totalprice) AS bigint) - 100000 AS arr,
       o.o_orderdate AS updated_at
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

TARGET = "DATE '1998-06-01'"
TARGET_INDEX = 1998 * 12 + 6 - 1


def window(lookback: int = 24, source: str = "am") -> str:
    start_total = TARGET_INDEX - lookback
    start = f"DATE '{start_total // 12:04d}-{start_total % 12 + 1:02d}-01'"
    return f"SELECT * FROM {source} WHERE month >= {start} AND month <= {TARGET}"


def latest(source: str) -> str:
    """Latest row per (account_id, month): updated_at descending, then the other columns ascending; nulls last."""
    return f"""
SELECT account_id, account_name, account_region, month, status, renewal_date, account_owner, arr, updated_at
FROM (SELECT *, row_number() OVER (
        PARTITION BY account_id, month
        ORDER BY updated_at DESC NULLS LAST, account_name ASC NULLS LAST, account_region ASC NULLS LAST,
                 status ASC NULLS LAST, renewal_date ASC NULLS LAST, account_owner ASC NULLS LAST,
                 arr ASC NULLS LAST) AS rn
      FROM {source}) q
WHERE rn = 1"""


def streak(source: str, lookback: int = 24) -> str:
    """Rank form: At-Risk first-of-month offsets from the target that equal their rank."""
    return f"""
SELECT account_id, count(*) AS d FROM (
  SELECT account_id, off, row_number() OVER (PARTITION BY account_id ORDER BY off) - 1 AS rk
  FROM (SELECT account_id,
               {TARGET_INDEX} - (year(month) * 12 + month(month) - 1) AS off
        FROM {source} WHERE status = 'At Risk' AND day(month) = 1) a
  WHERE off >= 0 AND off <= {lookback}) b
WHERE rk = off GROUP BY account_id"""


def with_(**ctes) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items())


def base(lookback: int = 24, floor: int = 0, region_values: str | None = None, am_sql: str | None = None) -> str:
    """Common CTEs: am, win, latest, streak, cand (candidates with streak), dim, routed."""
    values = region_values or ("('AMER', 'amer-risk-alerts'), ('EMEA', 'emea-risk-alerts'), "
                               "('APAC', 'apac-risk-alerts')")
    return with_(
        am=am_sql or AM_MONTH,
        win=window(lookback),
        latest=latest("win"),
        streak=streak("latest", lookback),
        cand=f"""
SELECT l.*, cast(greatest(coalesce(s.d, 0), 1) AS bigint) AS duration_months,
       cast({TARGET} - to_months(cast(greatest(coalesce(s.d, 0), 1) - 1 AS integer)) AS date) AS risk_start_month
FROM latest l LEFT JOIN streak s ON l.account_id = s.account_id
WHERE l.month = {TARGET} AND l.status = 'At Risk' AND (l.arr IS NULL OR l.arr >= {floor})
  AND l.account_id IS NOT NULL""",
        dim=f"SELECT * FROM (VALUES {values}) t(account_region, channel)",
        routed="""
SELECT c.*, d.channel, d.channel IS NOT NULL AS routable,
       CASE WHEN d.channel IS NULL THEN 'unknown_region' END AS reason
FROM cand c LEFT JOIN dim d ON c.account_region = d.account_region""",
    )


MESSAGE = r"""concat_ws(chr(10),
    '🚩 At Risk: ' || coalesce(account_name, 'None') || ' (' || coalesce(account_id, 'None') || ')',
    'Region: ' || coalesce(account_region, 'None'),
    'At Risk for: ' || cast(duration_months AS varchar) || ' months (since ' || strftime(risk_start_month, '%Y-%m-%d') || ')',
    'ARR: ' || coalesce('$' || format('{:,}', arr), 'Unknown'),
    'Renewal date: ' || coalesce(strftime(renewal_date, '%Y-%m-%d'), 'Unknown'),
    CASE WHEN account_owner IS NOT NULL AND account_owner <> '' THEN 'Owner: ' || account_owner END,
    'Details: https://app.yourcompany.com/accounts/' || coalesce(account_id, 'None'))"""

ALERTS = f"""SELECT account_id, account_name, account_region, channel, duration_months, risk_start_month,
       arr, routable, reason, {MESSAGE} AS message FROM routed"""

SQL: dict[str, str] = {
    "window_scan": with_(am=AM_MONTH) + "\n" + window(),
    "scan_counts": base() + """
SELECT cast(coalesce(sum(n), 0) AS bigint) AS rows_scanned, cast(coalesce(sum(n - 1), 0) AS bigint) AS duplicate_rows
FROM (SELECT count(*) AS n FROM win GROUP BY account_id, month) k""",
    "dedup_latest": base() + "\nSELECT * FROM latest",
    "dedup_key_counts": base() + """
SELECT account_id, count(DISTINCT month) AS n_months, count(*) AS n_rows,
       count(*) - count(DISTINCT month) AS duplicate_rows
FROM win GROUP BY account_id""",
    "candidates_arr_floor": base(floor=10000) + """
SELECT account_id, account_name, account_region, status, renewal_date, account_owner, arr FROM cand""",
    "streak_target": base() + "\nSELECT account_id, duration_months, risk_start_month FROM cand",
    "streak_short_lookback": base(lookback=2) + "\nSELECT account_id, duration_months, risk_start_month FROM cand",
    "streak_all_accounts": base() + f"""
SELECT a.account_id, cast(greatest(coalesce(s.d, 0), 1) AS bigint) AS duration_months,
       cast({TARGET} - to_months(cast(greatest(coalesce(s.d, 0), 1) - 1 AS integer)) AS date) AS risk_start_month
FROM (SELECT DISTINCT account_id FROM latest) a LEFT JOIN streak s ON a.account_id = s.account_id""",
    "streaks_all_months": with_(am=AM_MONTH, latest_all=latest("am")) + """
SELECT account_id, month,
       least(row_number() OVER (PARTITION BY account_id, isl ORDER BY mi), 25) AS duration_months,
       greatest(min(month) OVER (PARTITION BY account_id, isl),
                cast(month - INTERVAL 24 MONTH AS date)) AS risk_start_month
FROM (SELECT account_id, month, mi, mi - row_number() OVER (PARTITION BY account_id ORDER BY mi) AS isl
      FROM (SELECT account_id, month, year(month) * 12 + month(month) - 1 AS mi
            FROM latest_all WHERE status = 'At Risk' AND day(month) = 1) r) i""",
    "month_gaps": with_(am=AM_MONTH, latest_all=latest("am")) + """
SELECT account_id, month, cast(mi - prev - 1 AS bigint) AS missing_months
FROM (SELECT account_id, month, mi, lag(mi) OVER (PARTITION BY account_id ORDER BY mi) AS prev
      FROM (SELECT account_id, month, year(month) * 12 + month(month) - 1 AS mi
            FROM latest_all WHERE day(month) = 1) r) g
WHERE prev IS NOT NULL AND mi - prev > 1""",
    "route_regions": base() + "\nSELECT account_id, account_region, channel, routable, reason FROM routed",
    "route_counts": base() + """
SELECT count(*) AS at_risk_count, cast(coalesce(sum(CASE WHEN NOT routable THEN 1 ELSE 0 END), 0) AS bigint)
       AS unknown_region_count FROM routed""",
    "region_map_json": base(region_values="('AMER', 'west-desk'), ('EMEA', 'middle-desk'), "
                                          "('APAC', 'east-desk'), ('AFRICA', 'south-desk')") + """
SELECT account_id, account_region, channel, routable FROM routed""",
    "message_text": base() + f"\nSELECT account_id, {MESSAGE} AS message FROM routed",
    "message_payload": base() + f"\nSELECT account_id, json_object('text', {MESSAGE})::varchar AS payload FROM routed",
    "preview_alerts": base() + "\n" + ALERTS,
    "preview_counts": base() + f"""
SELECT {TARGET} AS month,
       (SELECT count(*) FROM win) AS rows_scanned,
       (SELECT count(*) FROM win) - (SELECT count(*) FROM latest) AS duplicate_rows,
       (SELECT count(*) FROM routed) AS at_risk_count,
       (SELECT count(*) FROM routed WHERE NOT routable) AS unknown_region_count,
       (SELECT count(*) FROM win WHERE account_id IS NULL) AS rejected_rows""",
    "preview_floor": base(floor=10000,
                          region_values="('AMER', 'west-desk'), ('EMEA', 'middle-desk'), "
                                        "('APAC', 'east-desk'), ('AFRICA', 'south-desk')")
    + "\n" + ALERTS,
    "month_contract": with_(am=AM_RAW) + """
SELECT account_id, count(*) AS n_rows, count(*) FILTER (WHERE day(month) <> 1) AS mid_month_rows
FROM am GROUP BY account_id""",
    "streak_mid_month": with_(am=AM_RAW, win=window(), latest=latest("win"), streak=streak("latest")) + f"""
SELECT a.account_id, cast(greatest(coalesce(s.d, 0), 1) AS bigint) AS duration_months,
       cast({TARGET} - to_months(cast(greatest(coalesce(s.d, 0), 1) - 1 AS integer)) AS date) AS risk_start_month
FROM (SELECT DISTINCT account_id FROM latest) a LEFT JOIN streak s ON a.account_id = s.account_id""",
}


# --- delivery, ledger, digest -------------------------------------------------------------

ATTEMPTS = """
SELECT delivery_id,
       cast(row_number() OVER (PARTITION BY delivery_id ORDER BY ts, event_id) - 1 AS bigint) AS attempt_no,
       CASE event_type WHEN 'purchase' THEN 200 WHEN 'click' THEN 429 WHEN 'error' THEN 500
                       WHEN 'view' THEN 503 ELSE 404 END AS status,
       CASE event_type WHEN 'click' THEN cast(cast(floor(value) AS bigint) AS varchar)
                       WHEN 'error' THEN 'soon' ELSE NULL END AS retry_after
FROM (SELECT *, concat(cast(user_id AS varchar), '/', cast(cast(ts AS date) AS varchar)) AS delivery_id
      FROM events) q"""

CLASS = """CASE WHEN status IS NULL THEN 'retry' WHEN status < 300 THEN 'ok'
            WHEN status = 429 OR (status >= 500 AND status < 600) THEN 'retry' ELSE 'fail' END"""

RA = "try_cast(retry_after AS double)"
WAIT = f"""coalesce(CASE WHEN trim(retry_after) <> '' AND {RA} >= 0 AND NOT isnan({RA}) AND NOT isinf({RA})
                         THEN {RA} END,
                    least(60.0, 1.0 * pow(2.0, attempt_no)))"""

# A delivery that neither ends nor has five recorded attempts goes on without a response until the fifth.
SCHEDULE = with_(
    rec=ATTEMPTS,
    ends=f"""SELECT delivery_id, max(attempt_no) AS last_rec,
                   count(*) FILTER (WHERE attempt_no < 5 AND {CLASS} <> 'retry') AS terminal FROM rec GROUP BY delivery_id""",
    att="""SELECT delivery_id, attempt_no, status, retry_after FROM rec WHERE attempt_no < 5
           UNION ALL SELECT delivery_id, cast(n AS bigint), NULL, NULL
           FROM ends, (VALUES (1), (2), (3), (4)) v(n) WHERE terminal = 0 AND n > last_rec""",
    g=f"SELECT delivery_id, attempt_no, status, retry_after, {CLASS} AS response_class FROM att",
    t="""SELECT *, coalesce(min(CASE WHEN response_class <> 'retry' THEN attempt_no END)
                           OVER (PARTITION BY delivery_id), 4) AS last_no FROM g""",
    s=f"""SELECT delivery_id, attempt_no, status, response_class,
                 CASE WHEN response_class = 'retry' AND attempt_no < last_no THEN {WAIT} END AS wait_seconds
          FROM t WHERE attempt_no <= last_no""",
    e="""SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY attempt_no DESC) AS rd,
                last_value(status IGNORE NULLS) OVER (PARTITION BY delivery_id ORDER BY attempt_no) AS seen,
                sum(wait_seconds) OVER (PARTITION BY delivery_id) AS total_wait FROM s""",
)

RESOLVE = SCHEDULE + """
SELECT delivery_id, response_class = 'ok' AS ok, cast(seen AS integer) AS status_code,
       cast(attempt_no + 1 AS bigint) AS attempts,
       CASE WHEN response_class = 'ok' THEN NULL
            WHEN response_class = 'fail' THEN 'HTTP ' || cast(status AS varchar) || ' (non-retryable)'
            WHEN status IS NULL THEN 'no recorded response'
            ELSE 'HTTP ' || cast(status AS varchar) END AS error,
       cast(coalesce(total_wait, 0) AS double) AS planned_wait_seconds
FROM e WHERE rd = 1"""

OUTCOME_LOG = """
SELECT cast(event_id AS bigint) AS seq, concat('r', cast(cast(ts AS date) AS varchar)) AS run_id,
       user_id AS account_id,
       CASE WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 'sent' ELSE 'failed' END AS status,
       CASE WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN NULL
            WHEN event_type = 'signup' THEN 'unknown_region' ELSE 'delivery_failed' END AS reason
FROM events"""

CURRENT = """
SELECT account_id, seq, run_id, status, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id
                               ORDER BY (status = 'sent') DESC,
                                        CASE WHEN status = 'sent' THEN seq END ASC NULLS LAST,
                                        seq DESC) AS rn
  FROM log) q WHERE rn = 1"""


def ledger_base() -> str:
    return base() + ",\n" + with_(
        log=OUTCOME_LOG,
        cur=CURRENT,
        cur_s="SELECT concat('a', lpad(cast(account_id AS varchar), cast(greatest(5, length(cast(account_id AS varchar))) AS integer), '0')) AS account_id, seq, run_id, status, "
              "reason FROM cur",
        sent="SELECT DISTINCT account_id FROM cur_s WHERE status = 'sent'",
        dec="""
SELECT r.*, CASE WHEN NOT r.routable THEN 'unknown_region'
                 WHEN s.account_id IS NOT NULL THEN 'skipped_replay' ELSE 'send' END AS decision,
            CASE WHEN NOT r.routable THEN 'unknown_region' ELSE 'would_send' END AS dry_decision
FROM routed r LEFT JOIN sent s ON r.account_id = s.account_id""",
    )[len("WITH "):]


DIGEST_LINE = """'  - ' || account_id || ' (' || account_name || ') region=' ||
                  CASE WHEN account_region IS NULL THEN 'None' ELSE '''' || account_region || '''' END"""
DIGEST_HEAD = "' account(s) got no alert because their region maps to no channel:'"
DIGEST_TO = "'support@example.com' AS \"to\", 'Accounts without a routed region' AS subject"


def digest(source: str = "routed") -> str:
    return base() + f"""
SELECT 'preview-1998-06-01' AS run_id, {DIGEST_TO}, 0 AS part, count(*) AS n_accounts, count(*) AS n_lines,
       'Run preview-1998-06-01: ' || cast(count(*) AS varchar) || {DIGEST_HEAD} || chr(10) ||
       string_agg({DIGEST_LINE}, chr(10) ORDER BY account_id) AS body
FROM {source} WHERE NOT routable HAVING count(*) > 0"""


SQL.update({
    "response_classes": with_(att=ATTEMPTS) + f"\nSELECT delivery_id, attempt_no, status, {CLASS} AS response_class FROM att",
    "backoff_schedule": SCHEDULE + "\nSELECT delivery_id, attempt_no, status, response_class, wait_seconds FROM s",
    "resolve_attempts": RESOLVE,
    "deliver_replay": RESOLVE,
    "outcomes_current": with_(log=OUTCOME_LOG) + "\n" + CURRENT,
    "already_sent_anti": ledger_base() + """
SELECT account_id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE s.account_id = c.account_id)""",
    "decisions": ledger_base() + "\nSELECT account_id, channel, decision FROM dec",
    "decision_counts": ledger_base() + """
SELECT cast(0 AS bigint) AS alerts_sent,
       count(*) FILTER (WHERE decision = 'skipped_replay') AS skipped_replay,
       count(*) FILTER (WHERE decision = 'unknown_region') AS failed_deliveries,
       count(*) FILTER (WHERE decision = 'send') AS to_send FROM dec""",
    "dry_run_counts": ledger_base() + """
SELECT count(*) FILTER (WHERE dry_decision = 'would_send') AS alerts_sent, cast(0 AS bigint) AS skipped_replay,
       count(*) FILTER (WHERE dry_decision = 'unknown_region') AS failed_deliveries,
       cast(0 AS bigint) AS to_send FROM dec""",
    "status_samples": ledger_base() + """
SELECT run_id, sample, account_id, status, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, sample ORDER BY account_id) AS rn
  FROM (SELECT *, CASE WHEN status IN ('sent', 'skipped_replay') THEN 'alert'
                       WHEN status = 'failed' THEN 'error' END AS sample FROM cur_s) a
  WHERE sample IS NOT NULL) b WHERE rn <= 10""",
    "unknown_region_digest": digest(),
    "unknown_region_digest_parts": base() + f"""
SELECT 'preview-1998-06-01' AS run_id, count(*) OVER () AS n_accounts, {DIGEST_LINE} AS line FROM routed WHERE NOT routable""",
    "unknown_region_digest_lines": base() + f"""
SELECT 'preview-1998-06-01' AS run_id, {DIGEST_TO}, account_id, {DIGEST_LINE} AS line FROM routed WHERE NOT routable""",
    "unknown_region_digest_none": digest("(SELECT * FROM routed WHERE routable)"),
    "run_month_replay": base() + """
SELECT cast(run_no AS bigint) AS run_no, 'succeeded' AS status,
       (SELECT count(*) FROM win) AS rows_scanned,
       (SELECT count(*) FROM win) - (SELECT count(*) FROM latest) AS duplicate_rows,
       CASE WHEN run_no = 1 THEN (SELECT count(*) FROM routed WHERE routable) ELSE 0 END AS alerts_sent,
       CASE WHEN run_no = 2 THEN (SELECT count(*) FROM routed WHERE routable) ELSE 0 END AS skipped_replay,
       (SELECT count(*) FROM routed WHERE NOT routable) AS failed_deliveries
FROM (VALUES (1), (2)) v(run_no)""",
})

SQL.update({
    "stream_dedup": SQL["dedup_latest"],
    "stream_alerts": SQL["preview_alerts"],
})

SQL.update({
    "orders_preview_alerts": base(am_sql=AM_ORDERS) + "\n" + ALERTS,
    "orders_preview_counts": base(am_sql=AM_ORDERS) + SQL["preview_counts"][len(base()):],
})

SQL["backfill_alerts"] = with_(
    am=AM_MONTH,
    latest_all=latest("am"),
    r="""SELECT *, year(month) * 12 + month(month) - 1 AS mi FROM latest_all
         WHERE status = 'At Risk' AND day(month) = 1""",
    i="SELECT *, mi - row_number() OVER (PARTITION BY account_id ORDER BY mi) AS isl FROM r",
    s="""SELECT *, least(row_number() OVER (PARTITION BY account_id, isl ORDER BY mi), 25) AS duration_months,
                greatest(min(month) OVER (PARTITION BY account_id, isl),
                         cast(month - INTERVAL 24 MONTH AS date)) AS risk_start_month
         FROM i""",
    routed="""SELECT s.*, d.channel, d.channel IS NOT NULL AS routable,
                     CASE WHEN d.channel IS NULL THEN 'unknown_region' END AS reason
              FROM s LEFT JOIN (VALUES ('AMER', 'amer-risk-alerts'), ('EMEA', 'emea-risk-alerts'),
                                       ('APAC', 'apac-risk-alerts')) d(account_region, channel)
                ON s.account_region = d.account_region
              WHERE s.arr IS NULL OR s.arr >= 0""",
) + f"""
SELECT month, account_id, account_name, account_region, channel, duration_months, risk_start_month,
       arr, routable, reason, {MESSAGE} AS message FROM routed"""

SQL.update({
    "stream_watermark": SQL["dedup_latest"],
    "stream_compacted": SQL["dedup_latest"],
    "stream_alerts_restarted": SQL["preview_alerts"],
    "load_and_deduplicate": SQL["dedup_latest"],
    "target_urls": base() + "\nSELECT account_id, 'http://receiver.invalid/hook/' || channel AS url FROM routed WHERE routable",
    "outcome_key_violations": with_(log=OUTCOME_LOG) + """
SELECT count(DISTINCT account_id) AS accounts, cast(0 AS bigint) AS violations FROM log""",
    "failed_run": """
SELECT cause, 'failed' AS status, cast(0 AS bigint) AS rows_scanned, cast(0 AS bigint) AS alerts_sent, cast(0 AS bigint) AS outcomes
FROM (VALUES ('missing column'), ('no transport')) v(cause)""",
    "streak_long_lookback": with_(am=AM_MONTH, win=window(80), latest=latest("win"), streak=streak("latest", 80)) + f"""
SELECT a.account_id, cast(greatest(coalesce(s.d, 0), 1) AS bigint) AS duration_months,
       cast({TARGET} - to_months(cast(greatest(coalesce(s.d, 0), 1) - 1 AS integer)) AS date) AS risk_start_month
FROM (SELECT DISTINCT account_id FROM latest) a LEFT JOIN streak s ON a.account_id = s.account_id""",
})


SQL.update({
    "send_intents_recovery": base() + """
SELECT account_id, state, CASE WHEN state IN ('recorded', 'salvaged') THEN 'crashed' ELSE 'repeat' END AS run_id, 'sent' AS status
FROM (SELECT account_id, CASE cast(right(account_id, 1) AS integer) % 3 WHEN 0 THEN 'recorded' WHEN 2 THEN 'never_posted'
        ELSE CASE WHEN cast(substr(account_id, length(account_id) - 1, 1) AS integer) < 5 THEN 'salvaged' ELSE 'unknown' END END AS state
      FROM routed WHERE routable) x""",
    "interleaved_runs": base() + """
SELECT account_id, CASE WHEN NOT routable THEN 'first' WHEN cast(right(account_id, 1) AS integer) % 2 = 0 THEN 'second' ELSE 'first' END AS run_id,
       CASE WHEN routable THEN 'sent' ELSE 'failed' END AS status, reason FROM routed""",
    "outcomes_compacted": SQL["outcomes_current"],
})

SQL.update({
    "stream_latest_state": base() + """
SELECT l.*, v.n_versions FROM latest l
JOIN (SELECT account_id, month, count(*) AS n_versions FROM win GROUP BY account_id, month) v USING (account_id, month)""",
    "stream_late_rows": with_(am=AM_MONTH) + f"""
SELECT month, CASE WHEN early THEN 0 ELSE n END AS accepted_rows, CASE WHEN early THEN n ELSE 0 END AS late_rows
FROM (SELECT month, month < {TARGET} - INTERVAL 24 MONTH AS early, count(*) AS n FROM am WHERE month <= {TARGET} GROUP BY month) x""",
    "stream_ledger": base() + """
SELECT account_id, CASE WHEN routable THEN 'sent' ELSE 'failed' END AS status, reason,
       cast(CASE WHEN routable THEN 1 ELSE 0 END AS bigint) AS sent_rows FROM routed""",
})

AM_PLACED = AM_MONTH.replace("AS updated_at\n", "AS updated_at, row_number() OVER (ORDER BY l.l_orderkey, l.l_linenumber) AS pos\n", 1)
SQL.update({
    "dedup_scan_order": with_(am=AM_PLACED, win=window()) + """
SELECT account_id, account_name, account_region, month, status, renewal_date, account_owner, arr, updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY account_id, month ORDER BY updated_at DESC NULLS LAST,
        CASE WHEN updated_at IS NULL THEN -pos ELSE pos END DESC) AS rn FROM win) q WHERE rn = 1""",
    "dedup_bucketed": SQL["dedup_latest"],
    "streaks_bucketed": SQL["streaks_all_months"],
    "unknown_region_digest_ordered": base() + f"""
SELECT row_number() OVER (ORDER BY account_id) - 1 AS place, {DIGEST_LINE} AS line, count(*) OVER () AS n_accounts
FROM routed WHERE NOT routable""",
})
