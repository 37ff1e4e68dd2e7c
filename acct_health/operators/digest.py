"""Unknown-region digest (I1, I2): which accounts of a run could not be routed.

``digest_lines`` is a table with one row per such account; it has the same form at every size.
``unknown_region_digest`` puts the lines together as texts to send: parts by ranges of account ids, so the
parts one after the other are the whole digest in account order. Runs cut it every ``LINES_PER_TEXT`` lines
unless their parameters name a number of parts, so no text or group grows with the accounts. No rows come
out when there are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The digest's wording is this library's own.
SUBJECT = "Accounts without a routed region"
LINES_PER_TEXT = 10_000
HEADER_TAIL = " account(s) got no alert because their region maps to no channel:"


def py_repr(c: Column) -> Column:
    """Python ``repr`` of an optional string: ``None``, or the text quoted the way Python quotes it."""
    has_single = F.instr(c, "'") > 0
    has_double = F.instr(c, '"') > 0
    escaped_single = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    escaped_double = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    quoted = (F.when(has_single & ~has_double, F.concat(F.lit('"'), escaped_double, F.lit('"')))
              .otherwise(F.concat(F.lit("'"), escaped_single, F.lit("'"))))
    return F.when(c.isNull(), F.lit("None")).otherwise(quoted)


def digest_line() -> Column:
    return F.concat(F.lit("  - "), F.coalesce(F.col("account_id"), F.lit("None")), F.lit(" ("),
                    F.coalesce(F.col("account_name"), F.lit("None")), F.lit(") region="),
                    py_repr(F.col("account_region")))


def digest_lines(routed: DataFrame, run_id: str, to: str | None = None) -> DataFrame:
    """(run_id, to, subject, account_id, line) for the unroutable rows of ``routed``."""
    return routed.where(~F.col("routable")).select(
        F.lit(run_id).alias("run_id"), F.lit(to).cast("string").alias("to"), F.lit(SUBJECT).alias("subject"),
        "account_id", digest_line().alias("line"))


def unknown_region_digest(routed: DataFrame, run_id: str, n_accounts: int, parts: int = 1,
                          to: str | None = None) -> DataFrame:
    """(run_id, to, subject, part, n_accounts, n_lines, body) for the unroutable rows of ``routed``.

    ``n_accounts`` is their number, which a run's counts have; nothing is counted here. A part holds its range of
    account ids in one row (ranges are sampled by Spark, so parts differ a little in length)."""
    lines = digest_lines(routed, run_id, to)
    if parts > 1:
        lines = lines.repartitionByRange(parts, "account_id")
    lines = lines.withColumn("part", F.spark_partition_id() if parts > 1 else F.lit(0))
    per_part = lines.groupBy("run_id", "to", "subject", "part").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("account_id", "line"))),
                                 lambda x: x.getField("line")), "\n").alias("lines"))
    head = F.lit(f"Run {run_id}: {int(n_accounts)}{HEADER_TAIL}\n")
    return per_part.select("run_id", "to", "subject", "part", F.lit(int(n_accounts)).cast("bigint").alias("n_accounts"),
                           "n_lines", F.concat(head, F.col("lines")).alias("body"))
