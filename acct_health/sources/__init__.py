from acct_health.sources.account_month import (
    ACCOUNT_MONTH_COLUMNS,
    ACCOUNT_MONTH_SCHEMA,
    month_window,
    read_account_month,
    validate_month,
)
from acct_health.sources.uri import resolve_uri

__all__ = [
    "ACCOUNT_MONTH_COLUMNS", "ACCOUNT_MONTH_SCHEMA", "month_window", "read_account_month",
    "resolve_uri", "validate_month",
]
