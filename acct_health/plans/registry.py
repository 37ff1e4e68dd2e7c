"""Registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame over the whole
test tables (target 1998-06-01, lookback 24 unless said otherwise)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acct_health.functions.backoff import response_class
from acct_health.functions.render import message_text, payload_json
from acct_health.operators.dedup import dedup_counts, latest_by_key, load_and_deduplicate
from acct_health.operators.delivery import (
    RetryPolicy,
    backoff_schedule,
    deliver,
    replay_transport,
    resolve_attempts,
    target_url,
)
from acct_health.operators.commits import new_entry, read_state, write_entry
from acct_health.operators.digest import digest_lines, unknown_region_digest
from acct_health.operators.intents import claim_sends, claim_states, record_wave, start_wave
from acct_health.operators.ledger import (
    LOG_SCHEMA,
    append_log,
    compact_month,
    current_outcomes,
    decide,
    decision_counts,
    key_violations,
    log_rows,
    read_log,
    read_runs,
    sent_keys,
    status_samples,
)
from acct_health.operators.routing import route, route_counts
from acct_health.operators.streak import month_gaps, streak_to, streaks_all
from acct_health.params import ALERT_TYPE, Params, parse_region_map, region_dim, region_dim_from_json
from acct_health.plans.alerts import ALERT_COLUMNS, backfill_alerts, candidates, preview
from acct_health.plans.run import decide_and_deliver, run_month
from acct_health.session import scratch_path
from acct_health.sources.account_month import month_window, read_account_month, validate_month, write_account_table
from acct_health.sources.fixtures import (
    LOOKBACK,
    TARGET_MONTH,
    account_month_from_orders,
    account_month_from_tables,
    attempts_from_events,
    outcome_log_from_events,
    padded_id,
)
from acct_health.streaming.stream import (
    compact_latest,
    read_alerts,
    read_feed,
    read_late_rows,
    read_latest,
    read_latest_state,
    run_alert_stream,
    run_latest_state,
    run_latest_stream,
)

Query = Callable[[SparkSession, str], DataFrame]

# The JSON region map of the region_map_json query (wrapped form, with an empty key that must never route).
REGION_JSON = ('{"regions": {"AMER": "west-desk", "EMEA": "middle-desk", '
               '"APAC": "east-desk", "AFRICA": "south-desk", "": "blank-region"}}')


def _am(spark, sf_dir):
    return account_month_from_tables(spark, sf_dir)


def _win(spark, sf_dir, lookback=LOOKBACK):
    return month_window(_am(spark, sf_dir), TARGET_MONTH, lookback)


def q_window_scan(spark, sf_dir):
    return _win(spark, sf_dir)


def q_scan_counts(spark, sf_dir):
    return dedup_counts(_win(spark, sf_dir))


def q_dedup_latest(spark, sf_dir):
    return latest_by_key(_win(spark, sf_dir))


def q_dedup_key_counts(spark, sf_dir):
    latest = latest_by_key(_win(spark, sf_dir), count_col="n_versions")
    return latest.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n_months"),
        F.sum("n_versions").cast("bigint").alias("n_rows"),
        F.sum(F.col("n_versions") - 1).cast("bigint").alias("duplicate_rows"))


def q_candidates_arr_floor(spark, sf_dir):
    c = candidates(_win(spark, sf_dir), TARGET_MONTH, Params(arr_threshold=10000))
    return c.select("account_id", "account_name", "account_region", "status", "renewal_date",
                    "account_owner", "arr")


def q_streak_target(spark, sf_dir):
    c = candidates(_win(spark, sf_dir), TARGET_MONTH, Params())
    return c.select("account_id", "duration_months", "risk_start_month")


def q_streak_short_lookback(spark, sf_dir):
    c = candidates(_win(spark, sf_dir, 2), TARGET_MONTH, Params(lookback_months=2))
    return c.select("account_id", "duration_months", "risk_start_month")


def q_streak_all_accounts(spark, sf_dir):
    """Bitmask streak for every account of the window, candidate or not (D1-D6 fallback)."""
    return streak_to(latest_by_key(_win(spark, sf_dir)), TARGET_MONTH, LOOKBACK)


def q_streaks_all_months(spark, sf_dir):
    return streaks_all(latest_by_key(_am(spark, sf_dir)), LOOKBACK)


def q_month_gaps(spark, sf_dir):
    return month_gaps(latest_by_key(_am(spark, sf_dir)))


def _routed(spark, sf_dir, params=None):
    params = params or Params()
    c = candidates(_win(spark, sf_dir), TARGET_MONTH, params)
    return route(c, region_dim(spark, params.region_channel_map), len(params.region_channel_map))


def q_route_regions(spark, sf_dir):
    return _routed(spark, sf_dir).select("account_id", "account_region", "channel", "routable", "reason")


def q_route_counts(spark, sf_dir):
    return route_counts(_routed(spark, sf_dir))


def q_region_map_json(spark, sf_dir):
    text = spark.createDataFrame([(REGION_JSON,)], "region_json string")
    dim = region_dim_from_json(spark, text)
    c = candidates(_win(spark, sf_dir), TARGET_MONTH, Params())
    # the dimension has at most as many entries as the JSON map has keys (known on the driver)
    return route(c, dim, dim_entries=len(parse_region_map(REGION_JSON))).select(
        "account_id", "account_region", "channel", "routable")


def q_message_text(spark, sf_dir):
    return _routed(spark, sf_dir).select("account_id", message_text(base_url=Params().details_base_url))


def q_message_payload(spark, sf_dir):
    msgs = q_message_text(spark, sf_dir)
    return msgs.select("account_id", payload_json("message"))


def q_preview_alerts(spark, sf_dir):
    alerts, _ = preview(spark, _am(spark, sf_dir), TARGET_MONTH, Params())
    return alerts


def q_preview_counts(spark, sf_dir):
    _, counts = preview(spark, _am(spark, sf_dir), TARGET_MONTH, Params())
    return counts


def q_preview_floor(spark, sf_dir):
    """Preview with an ARR floor of 10,000 and a region map that also routes AFRICA."""
    params = Params(arr_threshold=10000,
                    region_channel_map={"AMER": "west-desk", "EMEA": "middle-desk", "APAC": "east-desk",
                                        "AFRICA": "south-desk"})
    alerts, _ = preview(spark, _am(spark, sf_dir), TARGET_MONTH, params)
    return alerts.select(*ALERT_COLUMNS)


def q_month_contract(spark, sf_dir):
    raw = account_month_from_tables(spark, sf_dir, first_of_month=False)
    return raw.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.dayofmonth("month") != 1, 1)).alias("mid_month_rows"))


def q_streak_mid_month(spark, sf_dir):
    """Streak on a source whose months are raw dates: mid-month keys are never visited."""
    raw = account_month_from_tables(spark, sf_dir, first_of_month=False)
    return streak_to(latest_by_key(month_window(raw, TARGET_MONTH, LOOKBACK)), TARGET_MONTH, LOOKBACK)


QUERIES: dict[str, Query] = {
    "window_scan": q_window_scan,
    "scan_counts": q_scan_counts,
    "dedup_latest": q_dedup_latest,
    "dedup_key_counts": q_dedup_key_counts,
    "candidates_arr_floor": q_candidates_arr_floor,
    "streak_target": q_streak_target,
    "streak_short_lookback": q_streak_short_lookback,
    "streak_all_accounts": q_streak_all_accounts,
    "streaks_all_months": q_streaks_all_months,
    "month_gaps": q_month_gaps,
    "route_regions": q_route_regions,
    "route_counts": q_route_counts,
    "region_map_json": q_region_map_json,
    "message_text": q_message_text,
    "message_payload": q_message_payload,
    "preview_alerts": q_preview_alerts,
    "preview_counts": q_preview_counts,
    "preview_floor": q_preview_floor,
    "month_contract": q_month_contract,
    "streak_mid_month": q_streak_mid_month,
}


# --- delivery, ledger, digest -------------------------------------------------------------

NO_JITTER = RetryPolicy(jitter=False)
DIGEST_RUN_ID = "preview-1998-06-01"


def q_response_classes(spark, sf_dir):
    return attempts_from_events(spark, sf_dir).select(
        "delivery_id", "attempt_no", "status", response_class("status").alias("response_class"))


def q_backoff_schedule(spark, sf_dir):
    return backoff_schedule(attempts_from_events(spark, sf_dir), NO_JITTER, key="delivery_id")


def q_resolve_attempts(spark, sf_dir):
    return resolve_attempts(attempts_from_events(spark, sf_dir), NO_JITTER, key="delivery_id")


def q_deliver_replay(spark, sf_dir):
    """The delivery stage itself (retry loop in mapInPandas) answering from the recorded responses;
    must equal the closed form of ``resolve_attempts``."""
    att = attempts_from_events(spark, sf_dir)  # all responses on record: the loop stops by itself
    rows = (att.groupBy("delivery_id")
            .agg(F.array_sort(F.collect_list(F.struct("attempt_no", "status", "retry_after"))).alias("responses"))
            .select("delivery_id", F.lit("replay").alias("channel"), F.lit('{"text": "replay"}').alias("payload"),
                    "responses"))
    out = deliver(rows, replay_transport("responses"), NO_JITTER, base_url="http://receiver.invalid",
                  key_cols=("delivery_id",), keep=("delivery_id",), sleep=lambda s: None)
    return out.select("delivery_id", "ok", "status_code", "attempts", "error",
                      F.col("waited_seconds").alias("planned_wait_seconds"))


def _current(spark, sf_dir, string_ids=False):
    log = outcome_log_from_events(spark, sf_dir)
    if string_ids:
        log = log.withColumn("account_id", padded_id("a", F.col("account_id"), 5))
    return current_outcomes(log, key=("account_id",))


def q_outcomes_current(spark, sf_dir):
    return _current(spark, sf_dir).select("account_id", "seq", "run_id", "status", "reason")


def q_already_sent_anti(spark, sf_dir):
    c = candidates(_win(spark, sf_dir), TARGET_MONTH, Params()).select("account_id")
    return c.join(sent_keys(_current(spark, sf_dir, True)), on="account_id", how="left_anti")


def q_decisions(spark, sf_dir):
    d = decide(_routed(spark, sf_dir), sent_keys(_current(spark, sf_dir, True)), dry_run=False)
    return d.select("account_id", "channel", "decision")


def q_decision_counts(spark, sf_dir):
    return decision_counts(decide(_routed(spark, sf_dir), sent_keys(_current(spark, sf_dir, True)), dry_run=False))


def q_dry_run_counts(spark, sf_dir):
    return decision_counts(decide(_routed(spark, sf_dir), sent_keys(_current(spark, sf_dir, True)), dry_run=True))


def q_status_samples(spark, sf_dir):
    return status_samples(_current(spark, sf_dir, True)).select("run_id", "sample", "account_id", "status", "reason")


def _digest(spark, sf_dir, parts=1, only=None):
    routed = _routed(spark, sf_dir)
    routed = routed.where(only) if only else routed
    n = route_counts(routed).first()["unknown_region_count"]  # a run has it from its counts
    return unknown_region_digest(routed, DIGEST_RUN_ID, n, parts, "support@example.com")


def q_unknown_region_digest(spark, sf_dir):
    return _digest(spark, sf_dir)


def q_unknown_region_digest_parts(spark, sf_dir):
    """The lines of a digest in four texts, without the part numbers (their dealing is Spark's hash)."""
    return (_digest(spark, sf_dir, 4).select("run_id", "n_accounts", F.explode(F.slice(F.split("body", "\n"), 2, 1 << 30)).alias("line")))


def q_unknown_region_digest_lines(spark, sf_dir):
    return digest_lines(_routed(spark, sf_dir), DIGEST_RUN_ID, "support@example.com")


def q_unknown_region_digest_none(spark, sf_dir):
    """No digest where every alert is routed."""
    return _digest(spark, sf_dir, only="routable")


def _accept_all(req):
    """Deterministic receiver for the end-to-end check: every post is accepted."""
    return 200, {}


def q_run_month_replay(spark, sf_dir):
    """Two real runs of 1998-06-01 into a fresh ledger under the checkpoint folder: the second
    posts nothing and reports every routable candidate as skipped."""
    ledger = scratch_path(spark, "ledger")
    params = Params(webhook_base_url="http://receiver.invalid", retry_base_seconds=0.0, retry_cap_seconds=0.0)
    am = _am(spark, sf_dir)
    first = run_month(spark, am, TARGET_MONTH, ledger, params, transport=_accept_all, sleep=lambda s: None)
    second = run_month(spark, am, TARGET_MONTH, ledger, params, transport=_accept_all, sleep=lambda s: None)
    runs = read_runs(spark, ledger).where(F.col("id").isin(first, second))
    return runs.select(F.when(F.col("id") == first, 1).otherwise(2).cast("bigint").alias("run_no"),
                       "status", "rows_scanned", "duplicate_rows", "alerts_sent", "skipped_replay",
                       "failed_deliveries")


QUERIES.update({
    "response_classes": q_response_classes,
    "backoff_schedule": q_backoff_schedule,
    "resolve_attempts": q_resolve_attempts,
    "deliver_replay": q_deliver_replay,
    "outcomes_current": q_outcomes_current,
    "already_sent_anti": q_already_sent_anti,
    "decisions": q_decisions,
    "decision_counts": q_decision_counts,
    "dry_run_counts": q_dry_run_counts,
    "status_samples": q_status_samples,
    "unknown_region_digest": q_unknown_region_digest,
    "unknown_region_digest_parts": q_unknown_region_digest_parts,
    "unknown_region_digest_lines": q_unknown_region_digest_lines,
    "unknown_region_digest_none": q_unknown_region_digest_none,
    "run_month_replay": q_run_month_replay,
})


# --- the ledger under crashes, concurrent writers and compaction --------------------------------

def _outcomes(rows, run_id, seq, status="sent"):
    """Log rows of a run for (account_id, channel) rows of the target month."""
    return log_rows(rows.select(
        F.lit(run_id).alias("run_id"), F.lit(seq).cast("bigint").alias("seq"), "account_id", F.lit(ALERT_TYPE).alias("alert_type"),
        "channel", F.lit(status).alias("status"), F.when(F.lit(status == "failed"), "delivery_failed").alias("reason"),
        F.lit(None).cast("timestamp").alias("sent_at"), F.lit(None).cast("string").alias("error"), F.lit(1).cast("bigint").alias("attempts"),
        F.lit(200).alias("status_code"), F.lit(None).cast("timestamp").alias("recorded_at"), F.lit(TARGET_MONTH).cast("date").alias("month")))


def _alerts(spark, sf_dir):
    """The month's routed alerts, evaluated once."""
    alerts = preview(spark, _am(spark, sf_dir), TARGET_MONTH, Params(), materialize=True)[0]
    return alerts.withColumn("month", F.lit(TARGET_MONTH).cast("date"))


def _crashed_run(spark, ledger, routable):
    """A run that died in its second wave of three: the first is recorded, of the second only the tasks with an account
    whose last digit but one is below 5 had written their rows, the third was not started."""
    digit = lambda at: F.substring("account_id", at, 1).cast("int")
    sends = routable.select("account_id", "channel", (digit(-1) % 3).alias("wave"))
    if not claim_sends(spark, ledger, TARGET_MONTH, "crashed", sends, 3, 1, seconds=-1.0):
        raise RuntimeError("a new ledger had a commit")
    for wave, kept in ((0, F.lit(True)), (1, digit(-2) < 5)):
        entry = new_entry(TARGET_MONTH)
        start_wave(spark, ledger, TARGET_MONTH, "crashed", wave, entry, seconds=-1.0)
        write_entry(_outcomes(sends.where((F.col("wave") == wave) & kept), "crashed", 1), ledger, entry)
        if wave == 0:
            record_wave(spark, ledger, TARGET_MONTH, "crashed", wave, entry, seconds=-1.0)


def q_send_intents_recovery(spark, sf_dir):
    """What became of every intent of a crashed run, and which run's outcome counts after the month ran again."""
    ledger = scratch_path(spark, "ledger")
    alerts = _alerts(spark, sf_dir)
    _crashed_run(spark, ledger, alerts.where("routable"))
    claim = read_state(spark, ledger, TARGET_MONTH).claims["crashed"]
    path = scratch_path(spark, "states")
    claim_states(spark, ledger, claim, LOG_SCHEMA).write.parquet(path)
    params = Params(webhook_base_url="http://receiver.invalid", retry_base_seconds=0.0)
    decide_and_deliver(spark, alerts, TARGET_MONTH, ledger, params, _accept_all, "repeat", 2, sleep=lambda s: None)
    outcome = current_outcomes(read_log(spark, ledger, TARGET_MONTH)).select("account_id", "run_id", "status")
    states = spark.read.schema("account_id string, channel string, state string, wave int").parquet(path)
    return states.join(outcome, "account_id", "left").select("account_id", "state", "run_id", "status")


def q_interleaved_runs(spark, sf_dir):
    """Two runs of a month at once: a second run claims the accounts with an even last digit between the decision and the
    commit of the first, which decides again; the first then delivers before the second does. Outcomes by run."""
    ledger = scratch_path(spark, "ledger")
    alerts = _alerts(spark, sf_dir)
    even = alerts.where("routable").where(F.substring("account_id", -1, 1).cast("int") % 2 == 0) \
                 .select("account_id", "channel", F.lit(0).alias("wave"))
    params = Params(webhook_base_url="http://receiver.invalid", retry_base_seconds=0.0)
    came = []

    def second_run():
        if not came:
            came.append(claim_sends(spark, ledger, TARGET_MONTH, "second", even, 1, 1, seconds=3600.0))

    decide_and_deliver(spark, alerts, TARGET_MONTH, ledger, params, _accept_all, "first", 1, sleep=lambda s: None,
                       before_commit=second_run)
    entry = new_entry(TARGET_MONTH)
    start_wave(spark, ledger, TARGET_MONTH, "second", 0, entry, 3600.0)
    write_entry(_outcomes(even, "second", 2), ledger, entry)
    record_wave(spark, ledger, TARGET_MONTH, "second", 0, entry, 3600.0)
    return read_log(spark, ledger, TARGET_MONTH).select("account_id", "run_id", "status", "reason")


def q_outcomes_compacted(spark, sf_dir):
    """Current outcomes of a log that was compacted twice, with entries after the last snapshot: those of the whole log."""
    ledger = scratch_path(spark, "ledger")
    log = outcome_log_from_events(spark, sf_dir)
    rows = log.select("run_id", "seq", F.col("account_id").cast("string").alias("account_id"), F.lit(ALERT_TYPE).alias("alert_type"),
                      F.lit("all").alias("channel"), "status", "reason", F.lit(None).cast("timestamp").alias("sent_at"),
                      F.lit(None).cast("string").alias("error"), F.lit(1).cast("bigint").alias("attempts"),
                      F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("timestamp").alias("recorded_at"),
                      F.lit(TARGET_MONTH).cast("date").alias("month"))
    for part in range(5):
        append_log(rows.where(F.col("seq") % 5 == part), ledger, TARGET_MONTH)
        if part in (1, 3):
            compact_month(spark, ledger, TARGET_MONTH)
    current = current_outcomes(read_log(spark, ledger, TARGET_MONTH))
    return current.select(F.col("account_id").cast("bigint").alias("account_id"), "seq", "run_id", "status", "reason")


QUERIES.update({
    "send_intents_recovery": q_send_intents_recovery,
    "interleaved_runs": q_interleaved_runs,
    "outcomes_compacted": q_outcomes_compacted,
})


# --- streaming ----------------------------------------------------------------------------

def _feed(spark, sf_dir, batches=4, order=None):
    """Write the derived account months under the checkpoint folder and read them as a stream of about
    ``batches`` micro-batches. The number of files follows the rows; with ``order`` (a column of few values) the
    files arrive in its order and a value's rows are one micro-batch, so batches don't grow with the tables."""
    src = scratch_path(spark, "feed")
    am = _am(spark, sf_dir)
    if order is None:
        files = max(batches, -(-am.count() // FEED_FILE_ROWS))
        am.repartition(files).write.parquet(src)
        return read_feed(spark, src, files_per_trigger=-(-files // batches))
    return read_feed(spark, src, files_per_trigger=_write_in_order(am, order, src))


def _write_in_order(rows, order, src):
    """Write ``rows`` to the folder ``src``, one value of ``order`` after the other (rows without one are left out), and
    return how many files each value has: the same for all, so that many files a trigger make a micro-batch a value."""
    spark = rows.sparkSession
    counts = sorted(tuple(r) for r in rows.groupBy(order).count().collect() if r[0] is not None)
    files = max((-(-n // FEED_FILE_ROWS) for _, n in counts), default=1)
    if not counts:
        rows.limit(0).coalesce(1).write.parquet(src)
    there = 0
    for value, _ in counts:
        own = rows.where(order == F.lit(value))
        own.repartition(files).write.mode("append").parquet(src)
        while (now := len(_part_files(spark, src))) < there + files:  # fewer rows than files: empty ones make up for it
            own.limit(0).coalesce(1).write.mode("append").parquet(src)
        there = now
    return files


def _part_files(spark, path):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return [f for f in files if f.getPath().getName().startswith("part-")]


#: Rows in a file of the feeds and scans written for the queries.
FEED_FILE_ROWS = 1_000_000


def q_stream_dedup(spark, sf_dir):
    out, ckpt = scratch_path(spark, "stream-latest"), scratch_path(spark, "stream-ckpt")
    feed = month_window(_feed(spark, sf_dir), TARGET_MONTH, LOOKBACK)
    run_latest_stream(spark, feed, out, ckpt)
    return read_latest(spark, out).drop("n_versions")


def q_stream_watermark(spark, sf_dir):
    """A month-ordered feed of the whole history with a watermark of the lookback (K2): the window's
    months are those of the batch result, and rows after the target are rejected."""
    out, ckpt = scratch_path(spark, "stream-latest"), scratch_path(spark, "stream-ckpt")
    feed = _feed(spark, sf_dir, order=F.year("month"))
    run_latest_stream(spark, feed, out, ckpt, watermark_months=LOOKBACK, target_month=TARGET_MONTH)
    return month_window(read_latest(spark, out), TARGET_MONTH, LOOKBACK).drop("n_versions")


def q_stream_compacted(spark, sf_dir):
    """K1 over half of the feed, compacted, then the same stream over the rest on the compacted table."""
    out, ckpt = scratch_path(spark, "stream-latest"), scratch_path(spark, "stream-ckpt")
    src, compacted = scratch_path(spark, "feed"), scratch_path(spark, "stream-compacted")
    am = month_window(_am(spark, sf_dir), TARGET_MONTH, LOOKBACK).withColumn("half", F.pmod(F.xxhash64("updated_at", "arr"), F.lit(2)))
    am.where("half = 0").drop("half").write.parquet(src)
    run_latest_stream(spark, read_feed(spark, src), out, ckpt)
    compact_latest(spark, out, compacted)
    am.where("half = 1").drop("half").write.mode("append").parquet(src)
    run_latest_stream(spark, read_feed(spark, src), compacted, ckpt)
    return read_latest(spark, compacted).drop("n_versions")


def q_stream_alerts(spark, sf_dir):
    state, ckpt = scratch_path(spark, "stream-state"), scratch_path(spark, "stream-ckpt")
    run_alert_stream(spark, _feed(spark, sf_dir), TARGET_MONTH, Params(), state, ckpt)
    return read_alerts(spark, state)


def q_stream_alerts_restarted(spark, sf_dir):
    """The alert stream stopped half way and restarted on its state, with more buckets than some batches
    touch accounts."""
    state, ckpt, src = (scratch_path(spark, n) for n in ("stream-state", "stream-ckpt", "feed"))
    am = month_window(_am(spark, sf_dir), TARGET_MONTH, LOOKBACK).withColumn("few", F.col("account_id") < "a00004")
    for part in ("few", "not few"):
        am.where(part).drop("few").write.mode("append").parquet(src)
        run_alert_stream(spark, read_feed(spark, src), TARGET_MONTH, Params(), state, ckpt, state_buckets=16)
    return read_alerts(spark, state)


def q_stream_latest_state(spark, sf_dir):
    """K1 on bucketed snapshots: winners and their numbers of versions."""
    out, ckpt = scratch_path(spark, "stream-state"), scratch_path(spark, "stream-ckpt")
    run_latest_state(spark, month_window(_feed(spark, sf_dir), TARGET_MONTH, LOOKBACK), out, ckpt)
    return read_latest_state(spark, out)


def q_stream_late_rows(spark, sf_dir):
    """K2 over a feed that brings the newest year first: per month, the rows that were accepted and the rows that came
    too late for a watermark of the lookback. Together they are the input up to the target."""
    out, ckpt = scratch_path(spark, "stream-state"), scratch_path(spark, "stream-ckpt")
    run_latest_state(spark, _feed(spark, sf_dir, order=-F.year("month")), out, ckpt, LOOKBACK, TARGET_MONTH)
    accepted = read_latest_state(spark, out).groupBy("month").agg(F.sum("n_versions").alias("accepted_rows"))
    late = read_late_rows(spark, out).groupBy("month").agg(F.count(F.lit(1)).alias("late_rows"))
    return accepted.join(late, "month", "full").select(
        "month", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("accepted_rows", "late_rows")])


def q_stream_ledger(spark, sf_dir):
    """K3 with H1-H3: a month-ordered stream whose batches decide, post and record, then the last year's rows delivered a
    second time. Per account its outcome and how many of its rows in the log say sent."""
    state, ckpt, src, ledger = (scratch_path(spark, n) for n in ("stream-state", "stream-ckpt", "feed", "ledger"))
    am = month_window(_am(spark, sf_dir), TARGET_MONTH, LOOKBACK)
    params = Params(webhook_base_url="http://receiver.invalid", retry_base_seconds=0.0)
    last = F.year("month") == F.lit(validate_month(TARGET_MONTH).year)
    for part in (~last, last, last):
        am.where(part).write.mode("append").parquet(src)
        run_alert_stream(spark, read_feed(spark, src), TARGET_MONTH, params, state, ckpt, ledger_dir=ledger,
                         transport=_accept_all, sleep=lambda s: None)
    log = read_log(spark, ledger, TARGET_MONTH)
    sent = log.groupBy("account_id").agg(F.count(F.when(F.col("status") == "sent", 1)).alias("sent_rows"))
    return current_outcomes(log).select("account_id", "status", "reason").join(sent, "account_id")


QUERIES.update({
    "stream_latest_state": q_stream_latest_state,
    "stream_late_rows": q_stream_late_rows,
    "stream_ledger": q_stream_ledger,
    "stream_dedup": q_stream_dedup,
    "stream_watermark": q_stream_watermark,
    "stream_compacted": q_stream_compacted,
    "stream_alerts": q_stream_alerts,
    "stream_alerts_restarted": q_stream_alerts_restarted,
})


# --- low-duplicate input (orders) -----------------------------------------------------------

def q_orders_preview_alerts(spark, sf_dir):
    return preview(spark, account_month_from_orders(spark, sf_dir), TARGET_MONTH, Params())[0]


def q_orders_preview_counts(spark, sf_dir):
    return preview(spark, account_month_from_orders(spark, sf_dir), TARGET_MONTH, Params())[1]


QUERIES.update({
    "orders_preview_alerts": q_orders_preview_alerts,
    "orders_preview_counts": q_orders_preview_counts,
})


# --- backfill ------------------------------------------------------------------------------

def q_backfill_alerts(spark, sf_dir):
    """Preview alerts of every month of the history in one pass."""
    return backfill_alerts(spark, _am(spark, sf_dir), Params())


QUERIES["backfill_alerts"] = q_backfill_alerts


# --- operators that had no query of their own -------------------------------------------------

def q_load_and_deduplicate(spark, sf_dir):
    """A source written as Parquet, named by URI, loaded, windowed and deduplicated."""
    path = scratch_path(spark, "source")
    _am(spark, sf_dir).write.parquet(path)
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return load_and_deduplicate(spark, uri, TARGET_MONTH, LOOKBACK)[0]


def q_target_urls(spark, sf_dir):
    """G1: where the alert of each routable candidate is posted."""
    routed = _routed(spark, sf_dir).where("routable")
    return routed.select("account_id", target_url("channel", "http://receiver.invalid/hook/", "http://unused.invalid").alias("url"))


def q_outcome_key_violations(spark, sf_dir):
    """H4: accounts with more than one current outcome among all accounts (none)."""
    current = _current(spark, sf_dir)
    return current.agg(F.count(F.lit(1)).alias("accounts")).crossJoin(
        key_violations(current, ("account_id",)).agg(F.count(F.lit(1)).alias("violations")))


def q_failed_run(spark, sf_dir):
    """H7: a run whose source lacks a column and one without a transport are recorded as failed, with no
    alert posted or stored."""
    ledger = scratch_path(spark, "ledger")
    am, params = _am(spark, sf_dir), Params(webhook_base_url="http://receiver.invalid")
    first = run_month(spark, am.drop("arr"), TARGET_MONTH, ledger, params, transport=_accept_all)
    run_month(spark, am, TARGET_MONTH, ledger, params, transport=None)
    runs = read_runs(spark, ledger).select(F.when(F.col("id") == first, "missing column").otherwise("no transport").alias("cause"),
                                           "status", "rows_scanned", "alerts_sent")
    stored = read_log(spark, ledger).agg(F.count(F.lit(1)).alias("outcomes"))
    return runs.crossJoin(stored)  # one row beside two


def q_streak_long_lookback(spark, sf_dir):
    """A lookback of 80 months, more than one mask holds."""
    return streak_to(latest_by_key(_win(spark, sf_dir, 80)), TARGET_MONTH, 80)


QUERIES.update({
    "load_and_deduplicate": q_load_and_deduplicate,
    "target_urls": q_target_urls,
    "outcome_key_violations": q_outcome_key_violations,
    "failed_run": q_failed_run,
    "streak_long_lookback": q_streak_long_lookback,
})


# --- layouts, scan order, ordered parts ---------------------------------------------------------

def q_dedup_scan_order(spark, sf_dir):
    """The latest row per key where ties go by the scan, over files written in the order of the line items."""
    path = scratch_path(spark, "scan")
    place = ("l_orderkey", "l_linenumber")
    rows = account_month_from_tables(spark, sf_dir, keep=place)
    files = max(8, -(-rows.count() // FEED_FILE_ROWS))
    rows.repartitionByRange(files, *place).sortWithinPartitions(*place).drop(*place).write.parquet(path)
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    win = month_window(read_account_month(spark, uri, scan_position=True), TARGET_MONTH, LOOKBACK)
    return latest_by_key(win, tie_break="scan_order")


def _bucketed(spark, sf_dir, buckets=16):
    path = scratch_path(spark, "bucketed")
    return write_account_table(_am(spark, sf_dir), f"account_month_{path.rsplit('-', 1)[1]}", path, buckets)


def q_dedup_bucketed(spark, sf_dir):
    """The latest row per key from a table bucketed by account: no exchange."""
    return latest_by_key(month_window(_bucketed(spark, sf_dir), TARGET_MONTH, LOOKBACK))


def q_streaks_bucketed(spark, sf_dir):
    """Streaks of every month from the bucketed table: no exchange either."""
    return streaks_all(latest_by_key(_bucketed(spark, sf_dir)), LOOKBACK)


def q_unknown_region_digest_ordered(spark, sf_dir):
    """The lines of a digest in four texts, one text after the other: those of the one-part digest."""
    parts = _digest(spark, sf_dir, 4).select("part", F.slice(F.split("body", "\n"), 2, 1 << 30).alias("lines"), "n_accounts")
    whole = parts.groupBy("n_accounts").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "lines"))), lambda p: p["lines"])).alias("lines"))  # four rows
    return whole.select(F.posexplode("lines").alias("i", "line"), "n_accounts").select(
        F.col("i").cast("bigint").alias("place"), "line", "n_accounts")


QUERIES.update({
    "dedup_scan_order": q_dedup_scan_order,
    "dedup_bucketed": q_dedup_bucketed,
    "streaks_bucketed": q_streaks_bucketed,
    "unknown_region_digest_ordered": q_unknown_region_digest_ordered,
})
