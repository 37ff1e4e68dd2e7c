"""Latest row per key.

``groupBy(keys).agg(min(struct(sort key...)))``: the aggregate has a map-side partial,
so a key that holds a large share of all rows is reduced to one row per map task before the
shuffle. ``dropDuplicates`` would keep an arbitrary row and is not used.

Ordering (D-1): greatest ``updated_at`` wins and a null never beats a value; remaining ties are
broken by the other columns in their given order, each ascending with nulls last, so the result
is deterministic and the same in any engine (``ORDER BY updated_at DESC NULLS LAST, c1 ASC NULLS
LAST, ...``). The sort key is a struct of (is-null flag, value) pairs; descending columns are
reversed with a bitwise NOT of their integer form, which never overflows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_KEYS = ("account_id", "month")
DEFAULT_ORDER = ("updated_at",)



def ntz_micros(c: Column) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ from its date and clock fields, so no session
    time zone (and no daylight-saving gap or overlap) is involved."""
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    secs = F.hour(c).cast("bigint") * 3600 + F.minute(c).cast("bigint") * 60
    micros = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")  # seconds with fraction
    return days * 86_400_000_000 + secs * 1_000_000 + micros


def _as_long(c: Column, dtype: T.DataType) -> Column:
    """An order-preserving bigint of a numeric, boolean, date or timestamp column."""
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return c.cast("bigint")
    if isinstance(dtype, T.BooleanType):
        return c.cast("bigint")
    if isinstance(dtype, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("bigint")
    if isinstance(dtype, T.TimestampNTZType):
        return ntz_micros(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    raise TypeError(f"descending order needs an integer-like column, got {dtype.simpleString()}")


def sort_key(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
             order: Sequence[str] = DEFAULT_ORDER, position: str | None = None) -> list[Column]:
    """Fields whose struct minimum is the winning row: ``order`` descending, then the rest ascending,
    nulls last everywhere.

    With ``position`` (a scan-position column) ties on ``order`` go by scan order instead: the last
    scanned row wins among equal values, the first scanned among rows whose first order column is null.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    fields = []
    for i, c in enumerate(order):
        fields.append(F.col(c).isNull().alias(f"_on{i}"))
        v = F.col(c) if isinstance(types[c], (T.DoubleType, T.FloatType)) else None
        if v is not None:
            fields.append((-v).alias(f"_ov{i}"))
        else:
            fields.append(F.bitwise_not(_as_long(F.col(c), types[c])).alias(f"_ov{i}"))
    if position:
        p = F.col(position)
        fields.append(F.when(F.col(order[0]).isNotNull(), F.bitwise_not(p)).otherwise(p).alias("_pos"))
    rest = [c for c in df.columns if c not in keys and c not in order and c != position]
    for i, c in enumerate(rest):
        fields.append(F.col(c).isNull().alias(f"_tn{i}"))
        fields.append(F.col(c).alias(f"_tv{i}"))
    return fields


def latest_struct(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                  order: Sequence[str] = DEFAULT_ORDER, alias: str = "_latest",
                  position: str | None = None) -> Column:
    """Aggregate picking the winning row of a group: a struct of the sort key, which holds every other
    column once, and the order columns as they are (their sort form is reversed)."""
    own = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    return F.min(F.struct(*sort_key(df, keys, order, position), *own)).alias(alias)


def latest_columns(columns: Sequence[str], keys: Sequence[str] = DEFAULT_KEYS, order: Sequence[str] = DEFAULT_ORDER,
                   alias: str = "_latest", position: str | None = None) -> list[Column]:
    """``columns`` of the winning row again, from the grouped frame of :func:`latest_struct`."""
    rest = [c for c in columns if c not in keys and c not in order and c != position]
    place = {c: f"_o{i}" for i, c in enumerate(order)} | {c: f"_tv{i}" for i, c in enumerate(rest)}
    return [F.col(c) if c in keys else F.col(f"{alias}.{place[c]}").alias(c) for c in columns if c != position]


def latest_by_key(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                  order: Sequence[str] = DEFAULT_ORDER,
                  count_col: str | None = None, tie_break: str = "columns") -> DataFrame:
    """One row per key, the latest by ``order``; the original column order is kept.

    With ``count_col`` the number of input rows of each key is added (duplicates = count - 1).
    ``tie_break="scan_order"`` resolves ties by the ``_scan_pos`` column (see
    ``sources.account_month.with_scan_position``), which is dropped from the output.
    Works on any DataFrame; an empty input gives an empty output.
    """
    keys, order = list(keys), list(order)
    position = None
    if tie_break == "scan_order":
        position = "_scan_pos"
        if position not in df.columns:
            raise ValueError("tie_break='scan_order' needs a _scan_pos column (read with scan_position=True)")
    elif tie_break != "columns":
        raise ValueError(f"unknown tie_break {tie_break!r}")
    aggs = [latest_struct(df, keys, order, position=position)]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    grouped = df.groupBy(*keys).agg(*aggs)
    cols = latest_columns(df.columns, keys, order, position=position)
    if count_col:
        cols.append(F.col(count_col))
    return grouped.select(*cols)


def dedup_counts(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """One row: ``rows_scanned`` (rows of ``df``) and ``duplicate_rows`` (rows - distinct keys)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_scanned"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )


def deduplicate(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS,
                order: Sequence[str] = DEFAULT_ORDER) -> tuple[DataFrame, DataFrame]:
    """In-memory-table form (B5): (latest rows, one-row frame with ``duplicate_rows``)."""
    return latest_by_key(df, keys, order), dedup_counts(df, keys).select("duplicate_rows")


def load_and_deduplicate(spark, source_uri: str, target_month, lookback_months: int):
    """Read a source, keep its month window and deduplicate (B4): (latest rows, one-row counts frame
    with ``rows_scanned`` and ``duplicate_rows``). Both outputs are lazy."""
    from acct_health.sources.account_month import month_window, read_account_month
    window = month_window(read_account_month(spark, source_uri), target_month, lookback_months)
    return latest_by_key(window), dedup_counts(window)
