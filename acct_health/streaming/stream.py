"""Structured Streaming forms (K1-K3) of the same DataFrame functions.

K1  ``run_latest_state``: latest-by-key of an arriving feed, kept as one snapshot per account-hash bucket.
    A micro-batch reads the last snapshot of each bucket it touches, merges its own rows in, and writes the
    bucket's next snapshot; older ones go. So a batch costs what the touched buckets hold, and reading the
    result costs one snapshot a bucket, however many batches came before. ``latest_stream`` and
    ``run_latest_stream`` are the form with Spark's own streaming aggregate, whose emissions are appended.
K2  a watermark on the month (event time): ``run_latest_state`` writes rows that come too late to a table of
    late rows, so that late and accepted rows together are the input, and moves months that can't change
    any more out of the state into a table of closed ones. (``latest_stream`` has Spark's watermark, which drops
    late rows.) Only valid for a month-ordered feed and targets at or after the newest month seen. Rows after
    the target are taken out before the watermark, which they would push ahead, and are counted.
K3  ``run_alert_stream``: the state of K1 plus the current alerts, in snapshots of the same buckets.
    A late correction to an old month changes the streaks of later months, so the whole lookback of
    a bucket's accounts is computed anew rather than patched.

A snapshot carries its micro-batch's id and is made from the one before it, so a replayed batch
writes the same again. The number of buckets is stored with the state and can't change.
"""

from __future__ import annotations

import time
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acct_health.functions.months import month_minus
from acct_health.operators.dedup import latest_columns, latest_struct
from acct_health.params import Params
from acct_health.plans.alerts import ALERT_COLUMNS, materialize_candidates, routed_snapshot
from acct_health.plans.run import decide_and_deliver, record_run, write_digest
from acct_health.sources.account_month import (
    ACCOUNT_MONTH_COLUMNS,
    ACCOUNT_MONTH_SCHEMA,
    conform_account_month,
    month_window,
    validate_month,
)

KEYS = ("account_id", "month")
REJECTED = "rows_after_target"


# --- files and folders through Hadoop, so any cluster file system works ----------------------------

def _folder(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def _listed(spark: SparkSession, path: str) -> list:
    fs, where = _folder(spark, path)
    return list(fs.listStatus(where)) if fs.exists(where) else []


class FeedContract:
    """Checks the schema of every file of a feed before its rows are used: the schema a file source is
    started with would turn a missing column into nulls."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.seen = spark, path, set()

    def check(self) -> T.StructType | None:
        """Checks the files that are new since the last call; the first file's schema, None without files."""
        schema = None
        for f in _listed(self.spark, self.path):
            name = f.getPath().toString()
            if f.isFile() and name not in self.seen and not f.getPath().getName().startswith(("_", ".")):
                own = self.spark.read.parquet(name)
                conform_account_month(own)  # raises SourceContractError
                schema = schema or own.schema
                self.seen.add(name)
        return schema


def read_feed(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of account-month Parquet files as a stream, in the contract's columns and types.

    Files that are there are checked now. Pass ``FeedContract(spark, path)`` to the stream's run to have
    files that arrive later checked batch by batch."""
    schema = FeedContract(spark, path).check() or ACCOUNT_MONTH_SCHEMA
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return conform_account_month(r.parquet(path))


def latest_stream(feed: DataFrame, watermark_months: int | None = None, target_month=None) -> DataFrame:
    """Streaming latest-by-key (K1, K2): columns of the feed plus ``n_versions``.

    A watermark needs the target month: rows after it are dropped first, and counted as the metric
    ``rows_after_target`` of the query's progress (see :func:`rejected_rows`)."""
    df = feed.select(*ACCOUNT_MONTH_COLUMNS)
    keys = list(KEYS)
    if watermark_months is not None:
        if target_month is None:
            raise ValueError("a watermark needs the target month")
        late = F.col("month") > F.lit(validate_month(target_month))
        df = df.observe(REJECTED, F.count(F.when(late, 1)).alias("n")).where(~F.coalesce(late, F.lit(False)))
        df = df.withColumn("_month_ts", F.col("month").cast("timestamp")) \
               .withWatermark("_month_ts", f"{int(watermark_months) * 31} days")
        keys.append("_month_ts")
    src = df.drop("_month_ts") if "_month_ts" in df.columns else df
    agg = df.groupBy(*keys).agg(latest_struct(src, KEYS), F.count(F.lit(1)).alias("n_versions"))
    return agg.select(*latest_columns(ACCOUNT_MONTH_COLUMNS, KEYS), "n_versions")


def rejected_rows(query) -> int:
    """Rows after the target in the batches of the query's recent progress."""
    return sum(int(p["observedMetrics"][REJECTED]["n"] or 0) for p in query.recentProgress
               if REJECTED in (p["observedMetrics"] or {}))


def current_latest(emitted: DataFrame) -> DataFrame:
    """Winner per key across micro-batches: the emission of the highest batch id."""
    rest = [c for c in emitted.columns if c not in KEYS and c != "batch_id"]
    return (emitted.groupBy(*KEYS)
            .agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_cur"))
            .select(*KEYS, *[F.col(f"_cur.{c}").alias(c) for c in rest]))


def _start(stream: DataFrame, handler, checkpoint: str, available_now: bool = True):
    w = stream.writeStream.outputMode("update").foreachBatch(handler).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_latest_stream(spark: SparkSession, feed: DataFrame, out_dir: str, checkpoint: str,
                      watermark_months: int | None = None, available_now: bool = True, target_month=None,
                      contract: FeedContract | None = None):
    """K1: append each micro-batch's emissions (with ``batch_id``) under ``out_dir``."""
    def handle(batch: DataFrame, batch_id: int):
        if contract:
            contract.check()
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(out_dir)

    q = _start(latest_stream(feed, watermark_months, target_month), handle, checkpoint, available_now)
    if available_now:
        q.awaitTermination()
    return q


def read_latest(spark: SparkSession, out_dir: str) -> DataFrame:
    return current_latest(spark.read.parquet(out_dir)).select(*ACCOUNT_MONTH_COLUMNS, "n_versions")


def compact_latest(spark: SparkSession, out_dir: str, compacted_dir: str) -> None:
    """Rewrite K1's emissions as one row per key. A stream that goes on with ``compacted_dir`` as its
    output adds to it: these rows count as older than any batch's."""
    cur = current_latest(spark.read.parquet(out_dir))
    cur.withColumn("batch_id", F.lit(-1).cast("bigint")).write.parquet(compacted_dir)


# --- bucketed snapshots --------------------------------------------------------------------------

def account_bucket(buckets: int):
    """Hash bucket of the account id: snapshots are partitioned by it."""
    return F.pmod(F.xxhash64("account_id"), F.lit(buckets)).cast("int")


def fix_buckets(spark: SparkSession, state_dir: str, buckets: int) -> None:
    """Store the number of buckets with a new state; refuse another number for an existing one."""
    path = f"{state_dir}/layout"
    if _listed(spark, path):
        stored = spark.read.parquet(path).first()["buckets"]
        if stored != buckets:
            raise ValueError(f"the state in {state_dir} has {stored} buckets, not {buckets}")
    else:
        spark.createDataFrame([(int(buckets),)], "buckets int").coalesce(1).write.parquet(path)


def _versions(spark: SparkSession, table: str, bucket: int) -> list[int]:
    return sorted(int(f.getPath().getName().split("=")[1]) for f in _listed(spark, f"{table}/bucket={bucket}")
                  if f.getPath().getName().startswith("version="))


def _snapshots(spark: SparkSession, table: str, buckets, before: int | None = None) -> DataFrame | None:
    """The newest snapshot of each of ``buckets`` (older than ``before``), None if there is none."""
    paths = []
    for b in buckets:
        known = [v for v in _versions(spark, table, b) if before is None or v < before]
        if known:
            paths.append(f"{table}/bucket={b}/version={known[-1]}")
    return spark.read.option("basePath", table).parquet(*paths) if paths else None


def _write_snapshots(spark: SparkSession, rows: DataFrame, table: str, buckets, version: int, tasks_per_bucket: int) -> None:
    """One snapshot per bucket; those before the previous one are deleted."""
    spread = F.pmod(F.xxhash64("account_id", F.lit(1)), F.lit(tasks_per_bucket))
    (rows.withColumn("version", F.lit(version).cast("bigint"))
     .repartition(max(1, len(buckets) * tasks_per_bucket), "bucket", spread)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(table))
    for b in buckets:
        known = [v for v in _versions(spark, table, b) if v < version]
        for v in known[:-1]:
            fs, where = _folder(spark, f"{table}/bucket={b}/version={v}")
            fs.delete(where, True)


def _marks(spark: SparkSession, buckets) -> DataFrame:
    """A marker row for each bucket: it keeps the bucket's snapshot present when its last row goes."""
    return spark.createDataFrame([(int(b), True) for b in buckets], "bucket int, mark boolean")


def _merged(rows: DataFrame) -> DataFrame:
    """Winner and number of versions per key, of rows that may be winners of earlier rows (``n_versions`` each).
    The winner of winners is the winner of all rows, since the order among rows is fixed by the rows."""
    own = rows.select(*ACCOUNT_MONTH_COLUMNS)
    grouped = rows.groupBy(*KEYS, "bucket").agg(latest_struct(own, KEYS), F.sum("n_versions").alias("n_versions"))
    return grouped.select(*latest_columns(ACCOUNT_MONTH_COLUMNS, KEYS), "n_versions", "bucket")


def _arriving(feed: DataFrame, target_month=None) -> DataFrame:
    """The feed's rows as they are merged; rows after the target month are left out and counted."""
    df = feed.select(*ACCOUNT_MONTH_COLUMNS)
    if target_month is None:
        return df
    late = F.col("month") > F.lit(validate_month(target_month))
    return df.observe(REJECTED, F.count(F.when(late, 1)).alias("n")).where(~F.coalesce(late, F.lit(False)))


def _append(stream: DataFrame, handler, checkpoint: str, available_now: bool):
    """A stateless stream: all state is in the snapshots."""
    w = stream.writeStream.outputMode("append").foreachBatch(handler).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
    if available_now:
        q.awaitTermination()
    return q


def _stored_batch(rows: DataFrame, table: str, batch_id: int) -> None:
    """Rows of one batch in a table of all batches; a replayed batch writes the same again."""
    (rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(table))


def _newest_month(spark: SparkSession, out_dir: str, before: int):
    """The newest month that batches before this one brought (one row a batch, the last two are kept)."""
    table = f"{out_dir}/progress"
    known = sorted(int(f.getPath().getName().split("=")[1]) for f in _listed(spark, table) if f.getPath().getName().startswith("batch_id="))
    past = [b for b in known if b < before]
    for b in past[:-1]:
        fs, where = _folder(spark, f"{table}/batch_id={b}")
        fs.delete(where, True)
    return spark.read.schema("newest date").parquet(f"{table}/batch_id={past[-1]}").first()["newest"] if past else None


def run_latest_state(spark: SparkSession, feed: DataFrame, out_dir: str, checkpoint: str, watermark_months: int | None = None,
                     target_month=None, available_now: bool = True, state_buckets: int = 8, tasks_per_bucket: int = 1,
                     contract: FeedContract | None = None):
    """K1 and K2: keep the latest row per key under ``out_dir`` (see :func:`read_latest_state`).

    With ``watermark_months`` (which needs the target month) a row whose month is more than that many months before the
    newest month of the batches before it is late: it goes to the late rows (:func:`read_late_rows`), not into the
    state, and keys of such months are moved to a table of closed keys. Rows without a month are never late."""
    if watermark_months is not None and target_month is None:
        raise ValueError("a watermark needs the target month")
    fix_buckets(spark, out_dir, state_buckets)
    latest_dir = f"{out_dir}/latest"

    def handle(batch: DataFrame, batch_id: int):
        if contract:
            contract.check()
        rows = batch.withColumn("bucket", account_bucket(state_buckets)).persist()
        try:
            found = rows.agg(F.collect_set("bucket").alias("buckets"), F.max("month").alias("newest")).first()
            if not found["buckets"]:  # at most state_buckets values
                return
            touched, bound = found["buckets"], None
            accepted = rows.withColumn("n_versions", F.lit(1).cast("bigint"))
            if watermark_months is not None:
                seen = _newest_month(spark, out_dir, batch_id)
                bound = seen and month_minus(seen, watermark_months)
                newest = max(m for m in (seen, found["newest"]) if m) if seen or found["newest"] else None
                _stored_batch(spark.createDataFrame([(newest,)], "newest date").coalesce(1), f"{out_dir}/progress", batch_id)
            if bound:
                late = F.coalesce(F.col("month") < F.lit(bound), F.lit(False))
                _stored_batch(rows.where(late).drop("bucket"), f"{out_dir}/late", batch_id)
                accepted = accepted.where(~late)
            before = _snapshots(spark, latest_dir, touched, batch_id)
            if before is not None:
                accepted = accepted.unionByName(before.where("not mark").drop("version", "mark"))
            merged = _merged(accepted).withColumn("mark", F.lit(False))
            if bound:
                merged = merged.persist()
                over = F.coalesce(F.col("month") < F.lit(bound), F.lit(False))
                _stored_batch(merged.where(over).drop("bucket", "mark"), f"{out_dir}/closed", batch_id)
                live = merged.where(~over)
            else:
                live = merged
            _write_snapshots(spark, live.unionByName(_marks(spark, touched), allowMissingColumns=True), latest_dir, touched,
                             batch_id, tasks_per_bucket)
            if bound:
                merged.unpersist()
        finally:
            rows.unpersist()

    return _append(_arriving(feed, target_month), handle, checkpoint, available_now)


_LATEST_SCHEMA = T.StructType([*ACCOUNT_MONTH_SCHEMA.fields, T.StructField("n_versions", T.LongType())])


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not any(f.getPath().getName().startswith("batch_id=") for f in _listed(spark, path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def read_latest_state(spark: SparkSession, out_dir: str) -> DataFrame:
    """The latest row per key and its number of versions: the buckets' newest snapshots and the closed keys."""
    buckets = spark.read.parquet(f"{out_dir}/layout").first()["buckets"]
    live = _snapshots(spark, f"{out_dir}/latest", range(buckets))
    closed = _table(spark, f"{out_dir}/closed", _LATEST_SCHEMA)
    return closed if live is None else live.where("not mark").select(*_LATEST_SCHEMA.names).unionByName(closed)


def read_late_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    """Rows that came too late, as they came."""
    return _table(spark, f"{out_dir}/late", ACCOUNT_MONTH_SCHEMA)


def run_alert_stream(spark: SparkSession, feed: DataFrame, target_month, params: Params, state_dir: str,
                     checkpoint: str, available_now: bool = True, state_buckets: int = 8,
                     ledger_dir: str | None = None, transport=None, sleep=time.sleep,
                     tasks_per_bucket: int = 1, contract: FeedContract | None = None):
    """K3: keep the alert state of ``target_month`` current as rows arrive.

    A micro-batch rewrites the buckets it touches. Choose ``state_buckets`` so that a bucket is what a
    batch may rewrite, and ``tasks_per_bucket`` so that each of a bucket's files suits one task.

    With ``ledger_dir`` each micro-batch also alerts (H1-H3): the touched candidates are decided
    against the ledger's sent set, sends are posted through ``transport``, outcomes appended, and
    one run row per batch is recorded. A replayed batch or a later update of an account that was
    already sent posts nothing, because the ledger decides.
    """
    target = validate_month(target_month)
    if ledger_dir is not None and transport is None:
        raise ValueError("a stream with a ledger needs a transport")
    fix_buckets(spark, state_dir, state_buckets)
    latest_dir, alerts_dir = f"{state_dir}/latest", f"{state_dir}/alerts"
    window = month_window(feed, target, params.lookback_months)

    def handle(batch: DataFrame, batch_id: int):
        if contract:
            contract.check()
        emitted = batch.withColumn("bucket", account_bucket(state_buckets)).persist()  # used more than once
        try:
            # the touched buckets: at most state_buckets values
            touched = [r["bucket"] for r in emitted.select("bucket").distinct().collect()]
            if not touched:
                return
            rows = emitted.withColumn("n_versions", F.lit(1).cast("bigint"))
            before = _snapshots(spark, latest_dir, touched, batch_id)
            if before is not None:
                rows = rows.unionByName(before.drop("version"))
            _write_snapshots(spark, _merged(rows), latest_dir, touched, batch_id, tasks_per_bucket)
            state = _snapshots(spark, latest_dir, touched, batch_id + 1).drop("bucket", "version")
            routed = routed_snapshot(spark, None, target, params, latest=state).persist()
            try:
                current = routed.where("is_candidate").select(*ALERT_COLUMNS).withColumn("bucket", account_bucket(state_buckets))
                # a row without an account keeps each bucket's snapshot present when its last alert goes
                marks = spark.range(state_buckets).where(F.col("id").isin(touched)).select(F.col("id").cast("int").alias("bucket"))
                _write_snapshots(spark, current.unionByName(marks, allowMissingColumns=True), alerts_dir, touched, batch_id, tasks_per_bucket)
                if ledger_dir is not None:
                    changed = routed.join(emitted.select("account_id").distinct(), "account_id", "left_semi")
                    _alert_batch(spark, changed, target, params, ledger_dir, transport, sleep, batch_id, checkpoint)
            finally:
                routed.unpersist()
        finally:
            emitted.unpersist()

    return _append(_arriving(window), handle, checkpoint, available_now)


def _alert_batch(spark, routed, target, params, ledger_dir, transport, sleep, batch_id, checkpoint) -> None:
    """H1-H3 for the accounts a micro-batch touched, recorded as one run of the month. A stream is one writer: claims
    that an earlier start of it left open are taken over, so a batch that died in the middle is finished now."""
    stream = f"stream-{zlib.crc32(checkpoint.encode()):08x}-"
    run_id = f"{stream}{batch_id}-{uuid.uuid4().hex[:12]}"
    seq = time.time_ns() // 1000
    cands, counts = materialize_candidates(spark, routed, run_id)
    totals = decide_and_deliver(spark, cands, target, ledger_dir, params, transport, run_id, seq, sleep,
                                max_sends=counts["at_risk_count"] - counts["unknown_region_count"], take_over=stream)
    record_run(spark, ledger_dir, id=run_id, seq=seq, source_uri=f"stream batch {batch_id}", month=target,
               rows_scanned=counts["rows_scanned"], duplicate_rows=counts["duplicate_rows"],
               rejected_rows=counts["rejected_rows"], **totals)
    write_digest(cands, run_id, counts["unknown_region_count"], ledger_dir, params)


def read_alerts(spark: SparkSession, state_dir: str) -> DataFrame:
    """Current alerts: the newest snapshot of every bucket."""
    buckets = spark.read.parquet(f"{state_dir}/layout").first()["buckets"]
    rows = _snapshots(spark, f"{state_dir}/alerts", range(buckets))
    if rows is None:
        raise ValueError(f"no batch has been processed in {state_dir}")
    return rows.where(F.col("account_id").isNotNull()).select(*ALERT_COLUMNS)
