"""Continuous At-Risk duration (D1-D9): gaps and islands over the monthly series.

Walking back from the target month, a streak continues while the month exists and its
status is At Risk. Two equivalent plans are offered:

* bitmask (``risk_masks`` / ``streak_from_masks``): each At-Risk first-of-month row of the window
  sets bit ``target_index - month_index``; the streak is the number of trailing one bits. A long
  holds 62 months (bit 62 would be unsafe to add one to); a longer lookback takes further masks in
  the same aggregate, so there is one plan for every lookback, with a map-side partial.
* ranks (``streak_to_ranked``): among At-Risk months ordered newest first, the streak is the
  prefix whose offsets equal their ranks. Any lookback.

Mid-month dates are keys of their own that the walk never visits, so they never set a bit.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acct_health.functions.months import is_first_of_month, month_index
from acct_health.params import AT_RISK
from acct_health.sources.account_month import validate_month

#: Months in one mask.
MASK_MONTHS = 62


def _target_index(target: dt.date) -> int:
    return target.year * 12 + target.month - 1


def risk_bit(target_month, lookback_months: int, status_col: str = "status", month_col: str = "month",
             first_offset: int = 0) -> Column:
    """``1 << (target - month - first_offset)`` for an At-Risk first-of-month row within the lookback whose
    offset falls into the mask that begins at ``first_offset``, else 0."""
    target = validate_month(target_month)
    offset = F.lit(_target_index(target)) - month_index(month_col)
    last = min(lookback_months, first_offset + MASK_MONTHS - 1)
    ok = ((F.col(status_col) == F.lit(AT_RISK)) & is_first_of_month(month_col)
          & (offset >= first_offset) & (offset <= last))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (offset - first_offset).cast("int"))
    return F.when(ok, bit).otherwise(F.lit(0).cast("bigint"))


def risk_masks(target_month, lookback_months: int, status_col: str = "status", month_col: str = "month") -> list[Column]:
    """Aggregates risk_mask_0, risk_mask_1, ...: OR of :func:`risk_bit` over an account's deduplicated rows."""
    firsts = range(0, lookback_months + 1, MASK_MONTHS)
    return [F.bit_or(risk_bit(target_month, lookback_months, status_col, month_col, first)).alias(f"risk_mask_{i}")
            for i, first in enumerate(firsts)]


def streak_from_masks(masks: list[Column], target_month) -> tuple[Column, Column]:
    """(duration_months, risk_start_month) from the masks; duration is at least 1 (D6 fallback)."""
    target = validate_month(target_month)
    total = F.lit(0)
    for mask in reversed(masks):  # a full mask goes on in the next one
        ones = F.coalesce(F.bit_count(F.bitwise_not(mask).bitwiseAND(mask + 1) - 1), F.lit(0))
        total = ones + F.when(ones == MASK_MONTHS, total).otherwise(F.lit(0))
    duration = F.greatest(total, F.lit(1)).cast("bigint")
    start = F.add_months(F.lit(target), (F.lit(1) - duration).cast("int"))
    return duration.alias("duration_months"), start.alias("risk_start_month")


def mask_columns(lookback_months: int) -> list[Column]:
    return [F.col(f"risk_mask_{i}") for i in range(-(-(lookback_months + 1) // MASK_MONTHS))]


def truncated(lookback_months: int, duration: str = "duration_months") -> Column:
    """True when the streak reaches the window edge, so the real streak may be longer."""
    return (F.col(duration) >= F.lit(lookback_months + 1)).alias("is_truncated")


def streak_to(latest: DataFrame, target_month, lookback_months: int,
              key: str = "account_id", with_truncation: bool = False) -> DataFrame:
    """Streak ending at the target for every account of a deduplicated window frame (bitmask plan)."""
    per = latest.groupBy(key).agg(*risk_masks(target_month, lookback_months))
    duration, start = streak_from_masks(mask_columns(lookback_months), target_month)
    out = per.select(key, duration, start)
    return out.withColumn("is_truncated", truncated(lookback_months)) if with_truncation else out


def streak_to_ranked(latest: DataFrame, target_month, lookback_months: int,
                     key: str = "account_id") -> DataFrame:
    """Same result as :func:`streak_to` by ranks; for any lookback. Accounts without an
    At-Risk target month get the fallback (1, target)."""
    target = validate_month(target_month)
    offset = (F.lit(_target_index(target)) - month_index("month")).alias("offset")
    risky = (latest
             .where((F.col("status") == AT_RISK) & is_first_of_month("month"))
             .select(key, "month", offset)
             .where((F.col("offset") >= 0) & (F.col("offset") <= lookback_months)))
    w = Window.partitionBy(key).orderBy(F.col("offset"))
    ranked = risky.withColumn("_rk", F.row_number().over(w) - 1)
    run = ranked.where(F.col("_rk") == F.col("offset"))
    agg = run.groupBy(key).agg(F.count(F.lit(1)).alias("_d"))
    accounts = latest.select(key).distinct()
    agg = agg.withColumnRenamed(key, "_key")  # a null account is an account of its own
    out = accounts.join(agg, accounts[key].eqNullSafe(agg["_key"]), "left")
    duration = F.greatest(F.coalesce(F.col("_d"), F.lit(0)), F.lit(1)).cast("bigint")
    return out.select(key, duration.alias("duration_months"),
                      F.add_months(F.lit(target), (F.lit(1) - duration).cast("int")).alias("risk_start_month"))


def at_risk_months(latest: DataFrame) -> DataFrame:
    """The At-Risk first-of-month rows of a deduplicated frame (every column kept)."""
    return latest.where((F.col("status") == AT_RISK) & is_first_of_month("month"))


def with_island_streak(risky: DataFrame, lookback_months: int | None = None,
                       key: str = "account_id") -> DataFrame:
    """Add ``duration_months`` and ``risk_start_month`` to At-Risk month rows (gaps and islands):
    island = month index - rank; the streak ending at a row is its rank in the island, starting at
    the island's first month. ``lookback_months`` caps both at the window edge, as the windowed scan
    does; ``None`` leaves them uncapped. Both windows share one exchange on ``key``."""
    mi = month_index("month").alias("_mi")
    w = Window.partitionBy(key).orderBy("_mi")
    island = risky.withColumn("_mi", mi).withColumn("_island", F.col("_mi") - F.row_number().over(w))
    wi = Window.partitionBy(key, "_island").orderBy("_mi")
    duration = F.row_number().over(wi).cast("bigint")
    start = F.min("month").over(wi)
    if lookback_months is not None:
        duration = F.least(duration, F.lit(lookback_months + 1).cast("bigint"))
        start = F.greatest(start, F.add_months("month", -lookback_months))
    return (island.withColumn("duration_months", duration)
            .withColumn("risk_start_month", start)
            .drop("_mi", "_island"))


def streaks_all(latest: DataFrame, lookback_months: int | None = None,
                key: str = "account_id") -> DataFrame:
    """Streak for every At-Risk account-month in one pass (D9): what calling the target form
    once per month would give."""
    risky = at_risk_months(latest).select(key, "month")
    return with_island_streak(risky, lookback_months, key).select(key, "month", "duration_months",
                                                                  "risk_start_month")


def month_gaps(latest: DataFrame, key: str = "account_id") -> DataFrame:
    """Missing months per account (D4): for each first-of-month row, the number of absent months
    since the previous present one. Only rows following a gap are returned."""
    rows = latest.where(is_first_of_month("month")).select(key, "month", month_index("month"))
    w = Window.partitionBy(key).orderBy("month_index")
    prev = F.lag("month_index").over(w)
    return (rows.withColumn("_prev", prev)
            .where(F.col("_prev").isNotNull() & (F.col("month_index") - F.col("_prev") > 1))
            .select(key, "month", (F.col("month_index") - F.col("_prev") - 1).cast("bigint").alias("missing_months")))
