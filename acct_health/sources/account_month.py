"""The ``account_month`` source (A2-A7, J4): read, contract check, month window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acct_health.functions.months import month_minus
from acct_health.session import scratch_path
from acct_health.sources.uri import resolve_uri

ACCOUNT_MONTH_SCHEMA = T.StructType([
    T.StructField("account_id", T.StringType()),
    T.StructField("account_name", T.StringType()),
    T.StructField("account_region", T.StringType()),
    T.StructField("month", T.DateType()),
    T.StructField("status", T.StringType()),
    T.StructField("renewal_date", T.DateType()),
    T.StructField("account_owner", T.StringType()),
    T.StructField("arr", T.LongType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])
ACCOUNT_MONTH_COLUMNS = [f.name for f in ACCOUNT_MONTH_SCHEMA.fields]

_STRING_COLS = {"account_id", "account_name", "account_region", "status", "account_owner"}
_DATE_COLS = {"month", "renewal_date"}


class SourceContractError(ValueError):
    """The file lacks a required column or has a column of an unusable type."""


def validate_month(value) -> dt.date:
    """Strict ``YYYY-MM-DD`` text (or a date) whose day is 1, returned as a canonical date."""
    if isinstance(value, dt.datetime):
        value = value.date()
    if isinstance(value, dt.date):
        d = value
    else:
        text = str(value)
        if len(text) != 10 or text[4] != "-" or text[7] != "-":
            raise ValueError(f"month must be YYYY-MM-01, got {text!r}")
        d = dt.date.fromisoformat(text)
    if d.day != 1:
        raise ValueError("month must be the first day of the month (YYYY-MM-01)")
    return d


def _ntz_from_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _conform(field: T.StructField) -> Column:
    name, typ = field.name, field.dataType
    c = F.col(name)
    if name in _STRING_COLS:
        if not isinstance(typ, T.StringType):
            raise SourceContractError(f"column {name} must be a string, got {typ.simpleString()}")
        return c
    if name in _DATE_COLS:
        if isinstance(typ, T.DateType):
            return c
        if isinstance(typ, (T.TimestampType, T.TimestampNTZType)):
            return F.to_date(c).alias(name)
        raise SourceContractError(f"column {name} must be a date, got {typ.simpleString()}")
    if name == "arr":
        if isinstance(typ, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(name)
        raise SourceContractError(f"column arr must be an integer, got {typ.simpleString()}")
    # updated_at: naive micros arrive as NTZ; UTC-adjusted ones become the UTC wall time as NTZ;
    # nanosecond files read with spark.sql.legacy.parquet.nanosAsLong=true arrive as bigint nanos
    # (kept to the microsecond). Both conversions are epoch arithmetic, never through the session
    # time zone, where two instants of a daylight-saving overlap would share one wall time.
    if isinstance(typ, T.TimestampNTZType):
        return c
    if isinstance(typ, T.TimestampType):
        return _ntz_from_micros(F.unix_micros(c)).alias(name)
    if isinstance(typ, T.LongType):
        return _ntz_from_micros(F.floor(c / 1000)).alias(name)
    if isinstance(typ, T.DateType):
        return c.cast("timestamp_ntz").alias(name)
    raise SourceContractError(f"column updated_at must be a timestamp, got {typ.simpleString()}")


SCAN_POSITION = "_scan_pos"


def conform_account_month(df: DataFrame) -> DataFrame:
    """Check the nine columns exist with usable types and project them in the fixed order (A3).
    A scan-position column, when present, is kept."""
    by_name = {f.name: f for f in df.schema.fields}
    missing = [c for c in ACCOUNT_MONTH_COLUMNS if c not in by_name]
    if missing:
        raise SourceContractError(f"missing required columns: {', '.join(missing)}")
    extra = [F.col(SCAN_POSITION)] if SCAN_POSITION in by_name else []
    return df.select(*[_conform(by_name[c]) for c in ACCOUNT_MONTH_COLUMNS], *extra)


def file_ordinals(raw: DataFrame) -> DataFrame:
    """(_file, _file_ord): the files of a frame numbered in path order.

    Paths are range-partitioned and stored; a file's number is its place in its partition plus the files of the
    partitions before it, whose counts (one number a partition) are all that reaches the driver."""
    spark = raw.sparkSession
    path = scratch_path(spark, "files")
    files = raw.select(F.input_file_name().alias("_file")).distinct()
    files.repartitionByRange("_file").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    files = spark.read.schema("_file string, _part int").parquet(path)
    before, offsets = 0, [F.lit(-1), F.lit(0).cast("bigint")]  # never empty: a map needs a type
    for r in sorted(files.groupBy("_part").count().collect()):
        offsets += [F.lit(r["_part"]), F.lit(before).cast("bigint")]
        before += r["count"]
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_file")) - 1
    return files.select("_file", (F.element_at(F.create_map(*offsets), F.col("_part")) + place).alias("_file_ord"))


def with_scan_position(raw: DataFrame) -> DataFrame:
    """Add ``_scan_pos``: the row's place in a scan that reads files in path order and rows in file
    order (file ordinal * 2^40 + row index in the file). Used by the ``scan_order`` tie-break.

    The ordinals are a table of one row per file; its size decides how it is joined."""
    pos = raw.withColumn("_file", F.input_file_name()).withColumn("_row", F.col("_metadata.row_index"))
    joined = pos.join(file_ordinals(raw), on="_file", how="left")
    return joined.withColumn(SCAN_POSITION, F.col("_file_ord") * F.lit(1 << 40) + F.col("_row")) \
                 .drop("_file", "_row", "_file_ord")


def read_account_month(spark: SparkSession, source_uri: str, scan_position: bool = False) -> DataFrame:
    """Parquet file or folder -> the nine-column frame. Read with the file's own schema
    (an imposed schema would turn a missing column into silent NULLs). ``scan_position`` adds
    ``_scan_pos`` for the ``scan_order`` tie-break."""
    raw = spark.read.parquet(resolve_uri(source_uri))
    if scan_position:
        raw = with_scan_position(raw)
    return conform_account_month(raw)


def month_window(df: DataFrame, target_month, lookback_months: int) -> DataFrame:
    """``month`` between target-lookback and target, both ends inclusive (A4).

    Literal date bounds so the predicate reaches the Parquet scan (PushedFilters) and
    prunes month partitions when the table is laid out by month.
    """
    target = validate_month(target_month)
    start = month_minus(target, lookback_months)
    return df.where((F.col("month") >= F.lit(start)) & (F.col("month") <= F.lit(target)))


def mid_month_rows(df: DataFrame) -> DataFrame:
    """Rows whose ``month`` is not a first of month; the streak never visits them (J4 as a data check)."""
    return df.where(F.dayofmonth("month") != 1)


def write_account_month(df: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Write an account-month table laid out by month (partition pruning for the window scan).

    Rows are range-partitioned on (month, account_id) first, so each task writes a few month folders
    with balanced file sizes instead of every task writing a small file into every month.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, "month", "account_id")
     .write.mode(mode).partitionBy("month").parquet(path))


def write_account_table(df: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Write an account-month table bucketed and sorted by account, as catalog table ``name`` stored at ``path``, and
    read it back. The latest row per key, streaks and snapshots of it need no exchange, whatever the lookback; a month
    window still prunes by the files' statistics only. For feeds where no account holds much of all rows: a
    bucket is one task's. Other layouts are :func:`write_account_month`'s."""
    (df.repartition(buckets, "account_id").write.bucketBy(buckets, "account_id").sortBy("account_id", "month")
     .option("path", path).mode("errorifexists").saveAsTable(name))
    return conform_account_month(df.sparkSession.table(name))
