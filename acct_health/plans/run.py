"""Run a month end to end (J1) and read a run back.

1. Read + window + per-account snapshot; one job observes the counts over all accounts and
   checkpoints only the candidates into the shared checkpoint folder (the lineage cut; also the
   load guard: any load error becomes a failed run row, H7).
2. Current outcomes of the month from the ledger (partition-pruned), anti/semi logic as a join.
3. Decisions (H2) are made once and stored by wave. The sends are claimed as intents before any is posted
   (``operators/intents.py``); a run that finds another one's commits in its way decides again. Each wave
   reads its own slice and is one ``mapInPandas`` delivery stage written straight to an entry of the log in the
   same action; unroutable alerts are written with the first wave, replays to a table of their own.
4. Run counts observed while the outcome rows are written (no read-back); one run row appended;
   the unknown-region digest appended.

Delivery is at-least-once: a lost task, or the repeat of a run that died between a post and its record, can
post again, with the same idempotency key, which lets the receiver drop it. Concurrent runs don't post
one key both: each sends only what it claimed.
"""

from __future__ import annotations

import datetime as dt
import math
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from acct_health.functions.render import payload_json
from acct_health.operators.delivery import RetryPolicy, Transport, deliver, target_url
from acct_health.operators.commits import claimed_keys, new_entry, read_entries, read_state, write_entry
from acct_health.operators.digest import LINES_PER_TEXT, unknown_region_digest
from acct_health.operators.intents import UNKNOWN_SCHEMA, claim_sends, end_claim, held_keys, record_wave, recover, start_wave
from acct_health.operators.ledger import (
    RUNS_SCHEMA,
    CLAIMED,
    HELD,
    LOG_SCHEMA,
    SEND,
    SKIPPED,
    UNKNOWN_REGION,
    append_log,
    append_replays,
    append_run,
    current_outcomes,
    decide,
    decision_counts,
    digests_path,
    log_rows,
    outcome_count_columns,
    read_log,
    read_runs,
    read_table,
    sent_keys,
    status_samples,
)
from acct_health.params import ALERT_TYPE, Params
from acct_health.session import ensure_checkpoint_dir, scratch_path
from acct_health.plans.alerts import materialize_candidates, routed_snapshot
from acct_health.sources.account_month import (
    conform_account_month,
    month_window,
    read_account_month,
    validate_month,
)


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def _run_row(spark: SparkSession, base: dict, **values) -> DataFrame:
    merged = {**base, **values}
    row = {f.name: merged.get(f.name) for f in RUNS_SCHEMA.fields}
    return spark.createDataFrame([tuple(row[f.name] for f in RUNS_SCHEMA.fields)], RUNS_SCHEMA)


def _outcome_rows(df: DataFrame, run_id: str, seq: int, recorded_at: dt.datetime) -> DataFrame:
    return df.select(
        F.lit(run_id).alias("run_id"), F.lit(seq).cast("bigint").alias("seq"), "account_id",
        F.lit(ALERT_TYPE).alias("alert_type"), "channel", "status", "reason", "sent_at", "error",
        "attempts", "status_code", F.lit(recorded_at).alias("recorded_at"), "month")


def delivery_layout(max_sends: int, params: Params) -> tuple[int, int]:
    """(tasks per wave, waves) for at most ``max_sends`` posts, from the params or from the count."""
    waves = params.delivery_waves or max(1, math.ceil(max_sends / max(1, params.wave_size)))
    per_wave = math.ceil(max_sends / waves) if max_sends else 0
    tasks = params.delivery_partitions or min(params.max_delivery_tasks,
                                              max(1, math.ceil(per_wave / max(1, params.sends_per_task))))
    return int(tasks), int(waves)


def record_run(spark: SparkSession, ledger_dir: str, **fields) -> None:
    """Append one run row (H9); missing counts are 0, ``created_at`` defaults to now."""
    base = dict(dry_run=False, status="succeeded", created_at=_now(), rows_scanned=0, duplicate_rows=0,
                alerts_sent=0, skipped_replay=0, failed_deliveries=0, rejected_rows=0, claimed_elsewhere=0, held_unknown=0)
    append_run(_run_row(spark, base, **fields), ledger_dir)


_NO_WAVE = -1


def store_decisions(spark: SparkSession, decisions: DataFrame, waves: int, tasks: int) -> tuple[DataFrame, dict[str, int]]:
    """(decisions, how many of each label): the decisions, made once and written to the shared folder by wave,
    so a wave reads nothing but its own slice."""
    wave = F.when(F.col("decision") == SEND, F.pmod(F.xxhash64("account_id"), F.lit(waves))).otherwise(F.lit(_NO_WAVE))
    rows = decisions.select("account_id", "month", "channel", payload_json("message"), "decision", wave.cast("int").alias("wave"))
    seen = Observation(f"decisions-{uuid.uuid4().hex}")
    path = scratch_path(spark, "decisions")
    labels = (SEND, SKIPPED, UNKNOWN_REGION, CLAIMED, HELD)
    (rows.observe(seen, *[F.count(F.when(F.col("decision") == x, 1)).alias(x) for x in labels])
     .repartition(max(1, waves * tasks), "wave", F.pmod(F.xxhash64("account_id", F.lit(1)), F.lit(max(1, tasks))))
     .write.partitionBy("wave").parquet(path))
    return read_table(spark, path, rows.schema), {k: int(v or 0) for k, v in seen.get.items()}


def claim_run(spark: SparkSession, alerts: DataFrame, target, ledger_dir: str, params: Params, run_id: str,
              max_sends: int | None = None, before_commit: Callable[[], None] | None = None) -> tuple[DataFrame, dict[str, int], int, int]:
    """Decide every alert against the month's commits and claim the sends, deciding again for as long as another
    writer commits in between. (decisions, how many of each label, tasks per wave, waves).

    ``before_commit`` is called between a decision and its commit; tests let a second writer in there."""
    tasks, waves = delivery_layout(max_sends if max_sends is not None else params.wave_size, params)
    while True:
        state = read_state(spark, ledger_dir, target)
        log = read_entries(spark, ledger_dir, state.entries, LOG_SCHEMA)
        sent = sent_keys(current_outcomes(log), target, ALERT_TYPE)
        held = None
        if params.unknown_sends == "hold" and state.unknown:
            held = held_keys(read_entries(spark, ledger_dir, state.unknown, UNKNOWN_SCHEMA), log)
        decided = decide(alerts, sent, False, claimed=claimed_keys(spark, ledger_dir, state, run_id), held=held)
        decisions, found = store_decisions(spark, decided, waves, tasks)
        if before_commit:
            before_commit()
        sends = decisions.where(F.col("wave") != F.lit(_NO_WAVE))
        if not found[SEND] or claim_sends(spark, ledger_dir, target, run_id, sends, waves, state.version + 1, params.claim_seconds):
            return decisions, found, tasks, waves


def decide_and_deliver(spark: SparkSession, alerts: DataFrame, target, ledger_dir: str, params: Params,
                       transport: Transport, run_id: str, seq: int,
                       sleep: Callable[[float], None] = time.sleep, max_sends: int | None = None,
                       take_over: str | None = None, before_commit: Callable[[], None] | None = None) -> dict:
    """H1-H3 for a frame of routed candidates: decide against the ledger, claim and post the sends in waves, and
    record every outcome; returns the run counts (observed during the writes). The ledger decides, so running it
    again for the same alerts posts nothing new. Claims that have expired are recovered first, and so are those
    of runs whose id begins with ``take_over``, which the caller knows to be dead."""
    if transport is None:
        raise ValueError("a real run needs a transport")
    recover(spark, ledger_dir, target, LOG_SCHEMA, ALERT_TYPE, None if take_over is None else
            lambda c: c.until < time.time() or c.run_id.startswith(take_over))
    decisions, found, partitions, waves = claim_run(spark, alerts, target, ledger_dir, params, run_id, max_sends, before_commit)

    def unsent(which: str, status: str, reason: str | None) -> DataFrame:
        return decisions.where(F.col("wave") == F.lit(_NO_WAVE)).where(F.col("decision") == which).select(
            "account_id", "month", "channel", F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"),
            F.lit(None).cast("timestamp").alias("sent_at"), F.lit(None).cast("string").alias("error"),
            F.lit(None).cast("bigint").alias("attempts"), F.lit(None).cast("int").alias("status_code"))

    policy = RetryPolicy(params.retry_max_attempts, params.retry_base_seconds, params.retry_cap_seconds)
    totals = {"alerts_sent": 0, "skipped_replay": found[SKIPPED], "failed_deliveries": 0, CLAIMED: found[CLAIMED], HELD: found[HELD]}
    for label in (SKIPPED, CLAIMED, HELD):
        if found[label]:
            append_replays(_outcome_rows(unsent(label, label, None), run_id, seq, _now()), ledger_dir)
    unroutable = unsent(UNKNOWN_REGION, "failed", "unknown_region")

    def write(rows: DataFrame, write_rows: Callable[[DataFrame], None], name: str) -> None:
        # counts are observed while the rows are written: one action, no read-back
        seen = Observation(f"outcomes-{run_id}-{name}")
        write_rows(_outcome_rows(rows, run_id, seq, _now()).observe(seen, *outcome_count_columns()))
        for k, v in seen.get.items():
            totals[k] += int(v or 0)

    if not found[SEND]:
        if found[UNKNOWN_REGION]:
            write(unroutable, lambda rows: append_log(rows, ledger_dir, target), "unroutable")
        return totals
    for w in range(waves):
        entry = new_entry(target)
        start_wave(spark, ledger_dir, target, run_id, w, entry, params.claim_seconds)
        wave = decisions.where(F.col("wave") == F.lit(w)).select("account_id", "month", "channel", "payload")
        results = deliver(wave, transport, policy, params.webhook_base_url, params.webhook_url,
                          key_prefix=ALERT_TYPE, partitions=partitions, sleep=sleep)
        ok = F.col("ok")
        rows = results.select(
            "account_id", "month", "channel",
            F.when(ok, F.lit("sent")).otherwise(F.lit("failed")).alias("status"),
            F.when(~ok, F.lit("delivery_failed")).alias("reason"),
            "sent_at", "error", "attempts", "status_code")
        if w == 0:  # unroutable alerts ride along with the first wave's append
            rows = unroutable.unionByName(rows)
        write(rows, lambda x, e=entry: write_entry(log_rows(x), ledger_dir, e), str(w))
        record_wave(spark, ledger_dir, target, run_id, w, entry, params.claim_seconds)
    end_claim(spark, ledger_dir, target, run_id)
    return totals


def run_month(spark: SparkSession, source, month, ledger_dir: str, params: Params | None = None,
              transport: Transport | None = None, dry_run: bool = False,
              sleep: Callable[[float], None] = time.sleep, run_id: str | None = None, take_over: str | None = None) -> str:
    """Run one month; returns the run id. ``source`` is a URI or an already loaded DataFrame. ``take_over`` names
    runs (by the beginning of their ids; "" is all) that the caller knows to be dead: their claims are
    recovered now, and not when they expire."""
    params = params or Params()
    target = validate_month(month)
    ensure_checkpoint_dir(spark)
    run_id = run_id or str(uuid.uuid4())
    seq = time.time_ns() // 1000
    created = _now()
    source_uri = source if isinstance(source, str) else "<dataframe>"
    base = dict(id=run_id, seq=seq, source_uri=source_uri, month=target, dry_run=bool(dry_run), created_at=created,
                rows_scanned=0, duplicate_rows=0, alerts_sent=0, skipped_replay=0, failed_deliveries=0,
                rejected_rows=0)

    try:
        if not dry_run:
            target_url("channel", params.webhook_base_url, params.webhook_url)  # config checks before any job
            if transport is None:
                raise ValueError("a real run needs a transport")
        am = (read_account_month(spark, source, scan_position=params.tie_break == "scan_order")
              if isinstance(source, str) else conform_account_month(source))
        window = month_window(am, target, params.lookback_months)
        routed = routed_snapshot(spark, window, target, params)
        # One job: counts over every account are observed while only the candidates are checkpointed
        # into the shared checkpoint folder (the lineage cut every later job reads).
        alerts, counts = materialize_candidates(spark, routed, f"run-{run_id}")
    except Exception as exc:  # load failure -> failed run, id still returned
        append_run(_run_row(spark, base, status="failed", error=f"{type(exc).__name__}: {exc}"), ledger_dir)
        return run_id

    base.update(rows_scanned=counts["rows_scanned"], duplicate_rows=counts["duplicate_rows"],
                rejected_rows=counts["rejected_rows"])

    if dry_run:
        month_log = read_log(spark, ledger_dir, target)
        decisions = decide(alerts, sent_keys(current_outcomes(month_log), target, ALERT_TYPE), dry_run=True)
        c = decision_counts(decisions).first()
        append_run(_run_row(spark, base, status="succeeded", alerts_sent=c["alerts_sent"],
                            skipped_replay=0, failed_deliveries=c["failed_deliveries"]), ledger_dir)
        return run_id

    totals = decide_and_deliver(spark, alerts, target, ledger_dir, params, transport, run_id, seq, sleep,
                                max_sends=counts["at_risk_count"] - counts["unknown_region_count"], take_over=take_over)
    append_run(_run_row(spark, base, status="succeeded", **totals), ledger_dir)

    write_digest(alerts, run_id, counts["unknown_region_count"], ledger_dir, params)
    return run_id


def write_digest(alerts: DataFrame, run_id: str, n_unknown: int, ledger_dir: str, params: Params) -> None:
    """Append the unknown-region digest of a run (I1); nothing when every alert was routable."""
    if n_unknown:
        parts = params.digest_parts or math.ceil(n_unknown / LINES_PER_TEXT)
        (unknown_region_digest(alerts, run_id, n_unknown, parts, params.support_email)
         .withColumn("recorded_at", F.lit(_now()))
         .write.mode("append").parquet(digests_path(ledger_dir)))


def run_status(spark: SparkSession, ledger_dir: str, run_id: str, limit: int = 10) -> dict | None:
    """Run row, counts and up to ``limit`` sample alerts and errors (J3); None for an unknown id."""
    found = read_runs(spark, ledger_dir).where(F.col("id") == run_id).limit(1).collect()
    if not found:
        return None
    run = found[0].asDict()
    mine = current_outcomes(read_log(spark, ledger_dir, run["month"])).where(F.col("run_id") == run_id)
    samples = (status_samples(mine, limit)
               .select("sample", "account_id", "channel", "status", "reason", "error")
               .orderBy("sample", "account_id").collect())
    pick = lambda kind: [{k: r[k] for k in ("account_id", "channel", "status", "reason", "error")}
                         for r in samples if r["sample"] == kind]
    return {
        "run_id": run["id"], "status": run["status"], "month": run["month"], "dry_run": run["dry_run"],
        "error": run["error"],
        "counts": {k: run[k] for k in ("rows_scanned", "duplicate_rows", "alerts_sent", "skipped_replay",
                                       "failed_deliveries")},
        "rejected_rows": run["rejected_rows"],
        "sample_alerts": pick("alert"),
        "sample_errors": pick("error"),
    }
