"""Spark-native monthly account-health alerting.

Every core function takes and returns a DataFrame; the plan is declared with the DataFrame API and
Catalyst picks the physical strategy. The main entry points are importable from the package root::

    from acct_health import get_spark, Params, read_account_month, preview, run_month, run_status
"""

from __future__ import annotations

import importlib

_EXPORTS = {
    "Params": "acct_health.params",
    "get_spark": "acct_health.session",
    "read_account_month": "acct_health.sources.account_month",
    "write_account_month": "acct_health.sources.account_month",
    "month_window": "acct_health.sources.account_month",
    "latest_by_key": "acct_health.operators.dedup",
    "load_and_deduplicate": "acct_health.operators.dedup",
    "streak_to": "acct_health.operators.streak",
    "streaks_all": "acct_health.operators.streak",
    "route": "acct_health.operators.routing",
    "deliver": "acct_health.operators.delivery",
    "resolve_attempts": "acct_health.operators.delivery",
    "http_transport": "acct_health.operators.delivery",
    "current_outcomes": "acct_health.operators.ledger",
    "unknown_region_digest": "acct_health.operators.digest",
    "preview": "acct_health.plans.alerts",
    "candidates": "acct_health.plans.alerts",
    "run_month": "acct_health.plans.run",
    "run_status": "acct_health.plans.run",
    "run_alert_stream": "acct_health.streaming.stream",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    if name in _EXPORTS:
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(f"module 'acct_health' has no attribute {name!r}")
