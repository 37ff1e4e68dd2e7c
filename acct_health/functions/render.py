"""Message rendering (F1-F9) as column expressions: no Python per row.

Python formatting rules kept: a null value prints ``None``; ARR gets thousands separators,
``Unknown`` when null; "1 months" has no singular; the owner line is left out when null or
empty; lines are joined with a newline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed text of the message, in order of the lines.
HEADLINE_PREFIX = "\U0001F6A9 At Risk: "
REGION_PREFIX = "Region: "
DURATION_PREFIX = "At Risk for: "
ARR_PREFIX = "ARR: "
RENEWAL_PREFIX = "Renewal date: "
OWNER_PREFIX = "Owner: "
DETAILS_PREFIX = "Details: "
UNKNOWN = "Unknown"
NONE_TEXT = "None"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _py_str(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NONE_TEXT))


def iso_date(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")


def arr_text(arr="arr") -> Column:
    """``$15,702``, ``$-1,500``, ``$0`` or ``Unknown``."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(_c(arr).cast("bigint"), 0)), F.lit(UNKNOWN))


def details_url(base_url: str, account_id="account_id") -> Column:
    """``{base}/{id}`` (F7); the base is used as given (trim it when it comes from configuration)."""
    return F.concat(F.lit(base_url), F.lit("/"), _py_str(_c(account_id)))


def message_lines(duration="duration_months", start="risk_start_month",
                  base_url: str = "") -> list[Column]:
    return [
        F.concat(F.lit(HEADLINE_PREFIX), _py_str(F.col("account_name")), F.lit(" ("),
                 _py_str(F.col("account_id")), F.lit(")")),
        F.concat(F.lit(REGION_PREFIX), _py_str(F.col("account_region"))),
        F.concat(F.lit(DURATION_PREFIX), _py_str(_c(duration)), F.lit(" months (since "),
                 _py_str(iso_date(start)), F.lit(")")),
        F.concat(F.lit(ARR_PREFIX), arr_text("arr")),
        F.concat(F.lit(RENEWAL_PREFIX), F.coalesce(iso_date("renewal_date"), F.lit(UNKNOWN))),
        F.when(F.col("account_owner").isNotNull() & (F.col("account_owner") != ""),
               F.concat(F.lit(OWNER_PREFIX), F.col("account_owner"))),
        F.concat(F.lit(DETAILS_PREFIX), details_url(base_url)),
    ]


def message_text(duration="duration_months", start="risk_start_month", base_url: str = "") -> Column:
    """The full message (F1-F8); ``concat_ws`` skips the absent owner line."""
    return F.concat_ws("\n", *message_lines(duration, start, base_url)).alias("message")


def payload_json(text="message") -> Column:
    """``{"text": ...}``."""
    return F.to_json(F.struct(_c(text).alias("text"))).alias("payload")
