"""Send intents and what became of them (G4): a run writes the keys it will post before it posts any.

After a crash every intent of the dead run is in one of four states:

* ``recorded``: its wave's results are committed;
* ``salvaged``: its wave was started and not committed, but its task had finished, and the row it wrote is there;
* ``unknown``: its wave was started, and no row of it exists: it may have been posted;
* ``never_posted``: its wave was not started.

``recover`` closes a dead run's claim: salvaged rows count from then on, unknown keys are listed, and all but
the recorded and salvaged ones that were sent are free again. A later run posts unknown keys with the same idempotency
key, so a receiver that honours keys gets nothing twice. ``Params(unknown_sends="hold")`` keeps them back until
an outcome found out elsewhere is added for them (``ledger.append_log``).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acct_health.operators.commits import (
    Claim,
    commit_next,
    exists,
    read_entries,
    read_state,
    try_commit,
)

RECORDED, SALVAGED, UNKNOWN, NEVER_POSTED = "recorded", "salvaged", "unknown", "never_posted"
INTENT_SCHEMA = T.StructType([T.StructField("account_id", T.StringType()), T.StructField("channel", T.StringType()),
                              T.StructField("wave", T.IntegerType())])
UNKNOWN_SCHEMA = T.StructType([T.StructField("account_id", T.StringType()), T.StructField("channel", T.StringType()),
                               T.StructField("run_id", T.StringType()), T.StructField("seq", T.LongType()),
                               T.StructField("alert_type", T.StringType()),
                               T.StructField("month", T.DateType())])


def claim_sends(spark: SparkSession, ledger_dir: str, month, run_id: str, sends: DataFrame, waves: int, version: int,
                seconds: float) -> bool:
    """Write the intents (account_id, channel, wave) and claim them as commit ``version``; False if another writer
    has that number, in which case the decision they rest on is out of date."""
    intents = f"send_intents/month={month}/{run_id}-{uuid.uuid4().hex[:8]}"
    sends.select("account_id", "channel", F.col("wave").cast("int").alias("wave")).write.partitionBy("wave") \
         .parquet(f"{ledger_dir.rstrip('/')}/{intents}")
    return try_commit(spark, ledger_dir, month, version, {
        "kind": "claim", "run_id": run_id, "until": time.time() + seconds, "intents": intents, "waves": waves})


def start_wave(spark: SparkSession, ledger_dir: str, month, run_id: str, wave: int, entry: str, seconds: float) -> None:
    """From here on the wave's keys may have been posted."""
    commit_next(spark, ledger_dir, month, {"kind": "start", "run_id": run_id, "wave": wave, "entry": entry,
                                           "until": time.time() + seconds}, run_id)


def record_wave(spark: SparkSession, ledger_dir: str, month, run_id: str, wave: int, entry: str, seconds: float) -> None:
    commit_next(spark, ledger_dir, month, {"kind": "outcomes", "run_id": run_id, "wave": wave, "entry": entry,
                                           "until": time.time() + seconds}, run_id)


def end_claim(spark: SparkSession, ledger_dir: str, month, run_id: str) -> None:
    commit_next(spark, ledger_dir, month, {"kind": "end", "run_id": run_id}, run_id)


def intent_states(intents: DataFrame, found: DataFrame, started: list[int], recorded: list[int]) -> DataFrame:
    """``intents`` with the state of each; ``found`` has the account_id of rows that started waves left behind."""
    wave = F.col("wave")
    marked = intents.join(found.select("account_id").distinct().withColumn("_found", F.lit(True)), "account_id", "left")
    return marked.withColumn("state", F.when(wave.isin(recorded), RECORDED).when(~wave.isin(started), NEVER_POSTED)
                             .when(F.col("_found"), SALVAGED).otherwise(UNKNOWN)).drop("_found")


def claim_states(spark: SparkSession, ledger_dir: str, claim: Claim, log_schema) -> DataFrame:
    """State of every intent of a claim: (account_id, channel, wave, state)."""
    intents = spark.read.schema(INTENT_SCHEMA).parquet(f"{ledger_dir.rstrip('/')}/{claim.intents}")
    return intent_states(intents, read_entries(spark, ledger_dir, left_behind(spark, ledger_dir, claim), log_schema),
                         list(claim.started), claim.recorded)


def left_behind(spark: SparkSession, ledger_dir: str, claim: Claim) -> list[str]:
    """Entries of waves that were started and not recorded, as far as any task wrote to them."""
    return [e for w, e in sorted(claim.started.items()) if w not in claim.recorded and exists(spark, ledger_dir, e)]


def recover(spark: SparkSession, ledger_dir: str, month, log_schema, alert_type: str,
            dead: Callable[[Claim], bool] | None = None) -> list[str]:
    """Close the claims of dead runs, by default of those that have expired; returns their run ids."""
    dead = dead or (lambda c: c.until < time.time())
    closed = []
    while True:
        state = read_state(spark, ledger_dir, month)
        claim = next((c for c in state.claims.values() if dead(c)), None)
        if claim is None:
            return closed
        unknown = f"unknown_sends/month={month}/{claim.run_id}-{uuid.uuid4().hex[:8]}"
        rows = claim_states(spark, ledger_dir, claim, log_schema).where(F.col("state") == UNKNOWN).select(
            "account_id", "channel", F.lit(claim.run_id).alias("run_id"),
            F.lit(time.time_ns() // 1000).cast("bigint").alias("seq"), F.lit(alert_type).alias("alert_type"),
            F.lit(str(month)).cast("date").alias("month"))
        rows.write.parquet(f"{ledger_dir.rstrip('/')}/{unknown}")
        if try_commit(spark, ledger_dir, month, state.version + 1, {
                "kind": "recovered", "run_id": claim.run_id, "entries": left_behind(spark, ledger_dir, claim), "unknown": [unknown]}):
            closed.append(claim.run_id)


def held_keys(unknown: DataFrame, log: DataFrame) -> DataFrame:
    """account_id of unknown sends without an outcome of a later ``seq``."""
    later = log.groupBy("account_id").agg(F.max("seq").alias("_last"))
    return unknown.join(later, "account_id", "left").where(F.coalesce(F.col("_last") <= F.col("seq"), F.lit(True))).select("account_id")


def read_unknown(spark: SparkSession, ledger_dir: str, month) -> DataFrame:
    """Sends of dead runs that may have been posted and are not recorded (``UNKNOWN_SCHEMA``)."""
    return read_entries(spark, ledger_dir, read_state(spark, ledger_dir, month).unknown, UNKNOWN_SCHEMA)
