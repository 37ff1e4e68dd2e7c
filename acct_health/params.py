"""Run parameters and the region dimension.

Settings are plain arguments; only the region -> channel map is data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's for the same results:
# status that marks risk, the alert type of the outcome key, default routing
# AMER -> amer-risk-alerts, EMEA -> emea-risk-alerts, APAC -> apac-risk-alerts,
# default details link base, default lookback 24 months, ARR floor 0,
# retries: 5 attempts, base 1.0 s, cap 60.0 s.
AT_RISK = "At Risk"
ALERT_TYPE = "at_risk"
DEFAULT_REGION_MAP = {
    "AMER": "amer-risk-alerts",
    "EMEA": "emea-risk-alerts",
    "APAC": "apac-risk-alerts",
}
DEFAULT_DETAILS_BASE_URL = "https://app.yourcompany.com/accounts"
DEFAULT_LOOKBACK = 24
DEFAULT_ARR_THRESHOLD = 0
DEFAULT_MAX_ATTEMPTS = 5
DEFAULT_RETRY_BASE = 1.0
DEFAULT_RETRY_CAP = 60.0

# The region dimension is broadcast; a map larger than this is joined normally.
REGION_BROADCAST_MAX_ENTRIES = 100_000

REGION_DIM_SCHEMA = T.StructType([
    T.StructField("account_region", T.StringType(), False),
    T.StructField("channel", T.StringType(), True),
])


@dataclass(frozen=True)
class Params:
    """Everything a run needs besides the data."""

    region_channel_map: dict = field(default_factory=lambda: dict(DEFAULT_REGION_MAP))
    arr_threshold: int = DEFAULT_ARR_THRESHOLD
    lookback_months: int = DEFAULT_LOOKBACK
    details_base_url: str = DEFAULT_DETAILS_BASE_URL
    # "columns": ties on updated_at go to the smallest other columns (deterministic anywhere);
    # "scan_order": to the last scanned row (first when updated_at is null); needs a _scan_pos column.
    tie_break: str = "columns"
    webhook_base_url: str | None = None
    webhook_url: str | None = None
    retry_max_attempts: int = DEFAULT_MAX_ATTEMPTS
    retry_base_seconds: float = DEFAULT_RETRY_BASE
    retry_cap_seconds: float = DEFAULT_RETRY_CAP
    # The digest of unroutable accounts: its recipient, and into how many texts it is cut
    # (None: one for every digest.LINES_PER_TEXT lines).
    support_email: str | None = None
    digest_parts: int | None = None
    # Delivery parallelism: None sizes it from the number of sends (sends_per_task each, at most
    # max_delivery_tasks at once); waves bound how much one failed job can leave unrecorded.
    delivery_partitions: int | None = None
    sends_per_task: int = 200
    max_delivery_tasks: int = 256
    delivery_waves: int | None = None
    wave_size: int = 50_000
    # How long a run's claim on the keys it sends outlives its last commit: longer than its slowest wave.
    claim_seconds: float = 3600.0
    # Keys that a dead run may have posted: "resend" with the same idempotency key, or "hold".
    unknown_sends: str = "resend"

    def with_region_json(self, text: str | None) -> "Params":
        """The same parameters with the region map parsed from JSON text."""
        return replace(self, region_channel_map=parse_region_map(text))


def parse_region_map(text: str | None) -> dict:
    """``{"AMER": ..}`` or ``{"regions": {..}}``; a non-object routes nothing; unset or empty -> default."""
    if not text:
        return dict(DEFAULT_REGION_MAP)
    entries = json.loads(text)
    if isinstance(entries, dict) and "regions" in entries:
        entries = entries["regions"]
    return dict(entries) if isinstance(entries, dict) else {}


def region_dim(spark: SparkSession, region_map: dict) -> DataFrame:
    """Region -> channel as a small DataFrame; empty keys and null channels never route."""
    rows = [(k, v) for k, v in region_map.items()
            if isinstance(k, str) and k != "" and v is not None]
    rows = [(k, v if isinstance(v, str) else str(v)) for k, v in rows]
    return spark.createDataFrame(rows, REGION_DIM_SCHEMA)


def region_dim_from_json(spark: SparkSession, text_col: DataFrame) -> DataFrame:
    """Region dimension parsed on the executors from a one-column JSON text frame (column ``region_json``).

    Accepts both the flat and the ``{"regions": {..}}`` form, like :func:`parse_region_map`.
    """
    as_map = F.from_json("region_json", "map<string,string>")
    wrapped = F.from_json("region_json", "struct<regions:map<string,string>>").getField("regions")
    # a key "regions" is the wrapper whatever its value; one that is no object routes nothing
    has_wrapper = F.array_contains(F.json_object_keys("region_json"), "regions")
    chosen = F.when(has_wrapper, wrapped).otherwise(as_map)
    return (text_col
            .select(F.explode(chosen).alias("account_region", "channel"))
            .where((F.col("account_region") != "") & F.col("channel").isNotNull()))
