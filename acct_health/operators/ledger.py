"""Outcome ledger and idempotency.

The ledger is a log of outcome rows per month plus a deterministic "current" view: per (account_id,
month, alert_type) the first ``sent`` row, else the latest row. A ``sent`` row is therefore terminal, a
failed outcome is replaced by the next attempt, and replays are kept in a table beside the log, which
lookups don't read. Uniqueness is a property of the view's group key. Rows count once they are
committed (``operators/commits.py``): concurrent runs of a month claim the keys they send, and
``compact_month`` turns a month's entries into one snapshot without changing the view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acct_health.operators.commits import (
    commit_next,
    compact,
    months,
    new_entry,
    read_entries,
    read_state,
    write_entry,
)

OUTCOME_KEY = ("account_id", "month", "alert_type")

LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("alert_type", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("sent_at", T.TimestampType()),
    T.StructField("error", T.StringType()),
    T.StructField("attempts", T.LongType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("recorded_at", T.TimestampType()),
    T.StructField("month", T.DateType()),
])

RUNS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("source_uri", T.StringType()),
    T.StructField("month", T.DateType()),
    T.StructField("dry_run", T.BooleanType()),
    T.StructField("status", T.StringType()),
    T.StructField("rows_scanned", T.LongType()),
    T.StructField("duplicate_rows", T.LongType()),
    T.StructField("alerts_sent", T.LongType()),
    T.StructField("skipped_replay", T.LongType()),
    T.StructField("failed_deliveries", T.LongType()),
    T.StructField("rejected_rows", T.LongType()),
    T.StructField("claimed_elsewhere", T.LongType()),
    T.StructField("held_unknown", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])


def replays_path(ledger_dir: str) -> str:
    return f"{ledger_dir.rstrip('/')}/alert_replays"


def runs_path(ledger_dir: str) -> str:
    return f"{ledger_dir.rstrip('/')}/runs"


def digests_path(ledger_dir: str) -> str:
    return f"{ledger_dir.rstrip('/')}/digests"


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An append-only table, or an empty frame of its schema when nothing was written yet.
    Readers never require ``_SUCCESS``: finished tasks of a failed append stay readable."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_log(spark: SparkSession, ledger_dir: str, month=None) -> DataFrame:
    """Committed outcome rows, of one month or of all."""
    names = months(spark, ledger_dir) if month is None else [month]
    return read_entries(spark, ledger_dir, [e for m in names for e in read_state(spark, ledger_dir, m).entries], LOG_SCHEMA)


def read_runs(spark: SparkSession, ledger_dir: str) -> DataFrame:
    return read_table(spark, runs_path(ledger_dir), RUNS_SCHEMA)


def log_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields])


def append_log(rows: DataFrame, ledger_dir: str, month) -> None:
    """Add outcome rows of one month that rest on no decision of another writer."""
    entry = new_entry(month)
    write_entry(log_rows(rows), ledger_dir, entry)
    commit_next(rows.sparkSession, ledger_dir, month, {"kind": "outcomes", "entry": entry})


def compact_month(spark: SparkSession, ledger_dir: str, month) -> int:
    """One snapshot of the month's current outcomes in place of its entries (H3); returns how many it replaced."""
    return compact(spark, ledger_dir, month, current_outcomes, LOG_SCHEMA)


def append_replays(rows: DataFrame, ledger_dir: str) -> None:
    """Replays skipped by a run, in a table of their own: lookups of outcomes never read them."""
    log_rows(rows).write.mode("append").partitionBy("month").parquet(replays_path(ledger_dir))


def read_replays(spark: SparkSession, ledger_dir: str) -> DataFrame:
    return read_table(spark, replays_path(ledger_dir), LOG_SCHEMA)


def append_run(run_row: DataFrame, ledger_dir: str) -> None:
    (run_row.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RUNS_SCHEMA.fields])
     .coalesce(1).write.mode("append").parquet(runs_path(ledger_dir)))


def first_sent_else_latest(status: str = "status", seq: str = "seq") -> Column:
    """Rank struct whose maximum is the current row: any ``sent`` beats the rest, the earliest
    ``sent`` wins among sent rows, the latest row among the others."""
    is_sent = F.col(status) == F.lit("sent")
    return F.struct(is_sent.alias("_sent"),
                    F.when(is_sent, -F.col(seq)).otherwise(F.col(seq)).alias("_pos"))


def current_outcomes(log: DataFrame, key=OUTCOME_KEY, status: str = "status", seq: str = "seq") -> DataFrame:
    """One row per key: first sent, else latest (H3-H5). Map-side partial aggregation, so a key
    with many retries is reduced before the shuffle."""
    key = list(key)
    rest = [c for c in log.columns if c not in key]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), first_sent_else_latest(status, seq)).alias("_cur")
    return log.groupBy(*key).agg(best).select(*key, *[F.col(f"_cur.{c}").alias(c) for c in rest])


def sent_keys(current: DataFrame, month=None, alert_type: str | None = None,
              key: str = "account_id") -> DataFrame:
    """Accounts already recorded as sent (H1); filter on month and alert type when given."""
    cond = F.col("status") == F.lit("sent")
    if month is not None:
        cond = cond & (F.col("month") == F.lit(month))
    if alert_type is not None:
        cond = cond & (F.col("alert_type") == F.lit(alert_type))
    return current.where(cond).select(key).distinct()


# Fixed decision labels of a candidate, in order of precedence. The last two are of runs beside others:
# another run has claimed the key, or a dead run may have posted it and such keys are held.
UNKNOWN_REGION, WOULD_SEND, SKIPPED, SEND = "unknown_region", "would_send", "skipped_replay", "send"
CLAIMED, HELD = "claimed_elsewhere", "held_unknown"


def decide(candidates: DataFrame, sent: DataFrame, dry_run: bool, key: str = "account_id",
           claimed: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """Decision per candidate (H2): no channel -> unknown_region; dry run -> would_send; already sent ->
    skipped_replay; claimed by another run, or held -> not now; else send. The sets are joined, never collected."""
    known = sent.select(key).withColumn("_known", F.lit(SKIPPED))
    for rows, label in ((claimed, CLAIMED), (held, HELD)):
        if rows is not None:
            known = known.unionByName(rows.select(key).withColumn("_known", F.lit(label)))
    if claimed is not None or held is not None:
        first = F.when(F.col("_known") == SKIPPED, 0).when(F.col("_known") == CLAIMED, 1).otherwise(2)
        known = known.groupBy(key).agg(F.min_by("_known", first).alias("_known"))
    flagged = candidates.join(known, on=key, how="left")
    decision = (F.when(~F.col("routable"), F.lit(UNKNOWN_REGION))
                .when(F.lit(bool(dry_run)), F.lit(WOULD_SEND))
                .otherwise(F.coalesce("_known", F.lit(SEND))))
    return flagged.withColumn("decision", decision).drop("_known")


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Run counts implied by decisions alone (H6, H8): a dry run's alerts_sent counts would-sends and
    ignores already-sent; unknown regions always count as failed."""
    d = F.col("decision")
    return decisions.agg(
        F.count(F.when(d == WOULD_SEND, 1)).alias("alerts_sent"),
        F.count(F.when(d == SKIPPED, 1)).alias("skipped_replay"),
        F.count(F.when(d == UNKNOWN_REGION, 1)).alias("failed_deliveries"),
        F.count(F.when(d == SEND, 1)).alias("to_send"),
    )


def outcome_count_columns() -> list[Column]:
    """Run counts over outcome rows (H6), usable in ``agg`` or ``observe``."""
    s = F.col("status")
    return [F.count(F.when(s == "sent", 1)).alias("alerts_sent"),
            F.count(F.when(s == "skipped_replay", 1)).alias("skipped_replay"),
            F.count(F.when(s == "failed", 1)).alias("failed_deliveries")]


def outcome_counts(run_rows: DataFrame) -> DataFrame:
    """Counts of one run from its log rows (H6)."""
    return run_rows.agg(*outcome_count_columns())


def status_samples(current: DataFrame, limit: int = 10, run_col: str = "run_id") -> DataFrame:
    """Per run, up to ``limit`` alerts (sent / skipped_replay) and ``limit`` errors (failed) of the
    current outcomes, in account order (J3). ``row_number() <= limit`` plans a WindowGroupLimit."""
    sample = (F.when(F.col("status").isin("sent", "skipped_replay"), F.lit("alert"))
              .when(F.col("status") == "failed", F.lit("error")))
    tagged = current.withColumn("sample", sample).where(F.col("sample").isNotNull())
    w = Window.partitionBy(run_col, "sample").orderBy(F.col("account_id").asc_nulls_last())
    return (tagged.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= limit).drop("_rn"))


def key_violations(current: DataFrame, key=OUTCOME_KEY) -> DataFrame:
    """Keys that occur more than once (H4); empty for any view built by :func:`current_outcomes`."""
    return current.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
