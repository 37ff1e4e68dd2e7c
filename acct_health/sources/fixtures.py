"""Inputs derived by Spark from the shared test tables (lineitem, supplier, nation, region, events).

An account is a supplier and each line item is one version of that supplier's month; the
derivation plants duplicates, ``updated_at`` ties and nulls, missing months, null and negative
ARR, null and empty owners, a null region and an unmapped one. ``attempts`` and ``outcome_log``
come from ``events``. Nothing here is collected; all of it grows with the tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the test-data mapping: region names to account regions
# (AMERICA -> AMER, EUROPE -> EMEA, ASIA -> APAC, AFRICA -> AFRICA, anything else null),
# the target month and lookback used by the registered queries.
REGION_NAMES = {"AMERICA": "AMER", "EUROPE": "EMEA", "ASIA": "APAC", "AFRICA": "AFRICA"}
TARGET_MONTH = dt.date(1998, 6, 1)
LOOKBACK = 24


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation key -> account region code (fixed-size tables, broadcast)."""
    code = None
    for name, value in REGION_NAMES.items():
        cond = F.col("r_name") == F.lit(name)
        code = F.when(cond, F.lit(value)) if code is None else code.when(cond, F.lit(value))
    return (_read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
            .join(F.broadcast(_read(spark, sf_dir, "region").select("r_regionkey", "r_name")),
                  F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", code.alias("account_region")))


def padded_id(prefix: str, key: Column, width: int) -> Column:
    """``prefix`` and the key with leading zeros up to ``width`` digits; longer keys stay whole."""
    digits = key.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def account_month_from_tables(spark: SparkSession, sf_dir: str, first_of_month: bool = True, keep: tuple = ()) -> DataFrame:
    """The nine-column ``account_month`` frame built from the TPC-H-like tables.

    With ``first_of_month=False`` the raw ship date is the ``month`` (mid-month dates, for J4). ``keep`` names
    columns of lineitem that are added."""
    li = _read(spark, sf_dir, "lineitem").select(
        *[c for c in keep if c != "l_linenumber"],
        "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus", "l_shipdate")
    # gaps: in some months of each supplier nothing counts; those rows count for the month before, so
    # every line item stays an input row
    shipped = F.to_date("l_shipdate")
    skipped = (F.col("l_suppkey") + F.month("l_shipdate")) % 11 == 0
    counted = F.when(skipped, F.add_months(shipped, -1)).otherwise(shipped)
    # nation and region have a fixed number of rows; supplier grows with the data and is
    # left to Spark's size-based join choice.
    geo = _geo(spark, sf_dir)
    sup = (_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
           .join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey"))
           .select("s_suppkey", "s_name", "account_region"))
    j = li.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    ln = F.col("l_linenumber")
    return j.select(
        padded_id("a", F.col("l_suppkey"), 5).alias("account_id"),
        F.col("s_name").alias("account_name"),
        F.col("account_region"),
        (F.trunc(counted, "month") if first_of_month else counted).alias("month"),
        F.when(F.col("l_returnflag").isin("R", "A"), F.lit("At Risk"))
         .when(F.col("l_linestatus") == "O", F.lit("Healthy"))
         .otherwise(F.lit("Churned")).alias("status"),
        F.when(ln % 3 == 0, F.lit(None).cast("date")).otherwise(F.to_date("l_shipdate")).alias("renewal_date"),
        F.when(ln == 1, F.lit(None).cast("string"))
         .when(ln == 2, F.lit(""))
         .otherwise(F.concat(F.lit("owner"), ln.cast("string"), F.lit("@example.com"))).alias("account_owner"),
        F.when(F.col("l_quantity") < 5, F.lit(None).cast("bigint"))
         .otherwise(F.floor("l_extendedprice").cast("bigint") - 20000).alias("arr"),
        F.when(F.col("l_quantity") == 50, F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.col("l_shipdate")).alias("updated_at"),
        *keep,
    )


def account_month_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A low-duplicate account-month frame: an account is a customer, each order one version of that
    customer's month (about 6% duplicate keys, close to the few duplicates of real feeds).

    Status: open orders are At Risk, pending Healthy, finished Churned. Owner: null for urgent,
    empty for high priority, else by priority digit. ARR: floor(total price) - 100000 (some negative).
    """
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                              "o_orderpriority")
    geo = _geo(spark, sf_dir)
    cust = (_read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
            .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "c_name", "account_region"))
    j = o.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    return j.select(
        padded_id("c", F.col("o_custkey"), 6).alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.col("account_region"),
        F.trunc(F.to_date("o_orderdate"), "month").alias("month"),
        F.when(st == "O", F.lit("At Risk")).when(st == "P", F.lit("Healthy")).otherwise(F.lit("Churned"))
         .alias("status"),
        F.to_date("o_orderdate").alias("renewal_date"),
        F.when(pr == "1-URGENT", F.lit(None).cast("string")).when(pr == "2-HIGH", F.lit(""))
         .otherwise(F.concat(F.lit("owner"), F.substring(pr, 1, 1), F.lit("@example.com"))).alias("account_owner"),
        (F.floor("o_totalprice").cast("bigint") - 100000).alias("arr"),
        F.col("o_orderdate").alias("updated_at"),
    )


def attempts_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded responses of deliveries: (delivery_id, attempt_no, status, retry_after), one per event.

    A delivery is one user's day, so a busy user's events are many deliveries and no group grows
    with the table. All events are attempts; where a delivery ends is the operators' decision.
    """
    ev = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    delivery = F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    w = Window.partitionBy("delivery_id").orderBy("ts", "event_id")
    et = F.col("event_type")
    status = (F.when(et == "purchase", 200).when(et == "click", 429).when(et == "error", 500)
              .when(et == "view", 503).otherwise(404))
    retry_after = (F.when(et == "click", F.floor("value").cast("bigint").cast("string"))
                   .when(et == "error", F.lit("soon")))
    return (ev.withColumn("delivery_id", delivery)
            .select("delivery_id", (F.row_number().over(w) - 1).cast("bigint").alias("attempt_no"),
                    status.alias("status"), retry_after.alias("retry_after")))


def outcome_log_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome log with a row for every event: ``seq`` is the event's number, a run is a day.

    Only even users can be ``sent``, so the "latest failure" branch of the current view is exercised.
    """
    ev = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    sent = (F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 0)
    return ev.select(
        F.col("event_id").cast("bigint").alias("seq"),
        F.concat(F.lit("r"), F.to_date("ts").cast("string")).alias("run_id"),
        F.col("user_id").alias("account_id"),
        F.when(sent, "sent").otherwise("failed").alias("status"),
        F.when(sent, F.lit(None).cast("string"))
         .when(F.col("event_type") == "signup", "unknown_region")
         .otherwise("delivery_failed").alias("reason"))
