"""Region -> channel routing (E1, E2, E4) as a left equi-join to a small dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acct_health.params import REGION_BROADCAST_MAX_ENTRIES


def route(df: DataFrame, dim: DataFrame, dim_entries: int | None = None,
          region_col: str = "account_region") -> DataFrame:
    """Add ``channel``, ``routable`` and ``reason``.

    Exact, case-sensitive, untrimmed match; a null or empty region never matches because the
    dimension holds no empty key and an equi-join never matches null. The dimension is broadcast
    when its entry count is known and under the bound; otherwise Spark chooses from its statistics.
    """
    dim = dim.select(F.col("account_region").alias(region_col), "channel")
    if dim_entries is not None and dim_entries <= REGION_BROADCAST_MAX_ENTRIES:
        dim = F.broadcast(dim)
    routed = df.join(dim, on=region_col, how="left")
    routable = F.col("channel").isNotNull()
    return (routed
            .select(*df.columns, "channel")
            .withColumn("routable", routable)
            .withColumn("reason", F.when(~routable, F.lit("unknown_region"))))


def route_counts(routed: DataFrame) -> DataFrame:
    """One row: candidates and unroutable candidates."""
    return routed.agg(
        F.count(F.lit(1)).alias("at_risk_count"),
        F.coalesce(F.sum(F.when(~F.col("routable"), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("unknown_region_count"),
    )
