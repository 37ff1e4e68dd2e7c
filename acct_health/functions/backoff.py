"""Retry rules (G2, G3) as column expressions and as the plain-Python twin used inside the
delivery task. Both follow the same rules, so the closed form and the delivery stage agree."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed response classes.
OK, RETRY, FAIL = "ok", "retry", "fail"


def response_class(status="status") -> Column:
    """< 300 ok; 429 or 5xx retry; anything else fails at once. A null status (transport error) retries."""
    s = F.col(status) if isinstance(status, str) else status
    return (F.when(s.isNull(), F.lit(RETRY))
            .when(s < 300, F.lit(OK))
            .when((s == 429) | ((s >= 500) & (s < 600)), F.lit(RETRY))
            .otherwise(F.lit(FAIL)))


# Decimal number text as Python's float() reads it (after whitespace and digit-group underscores
# are removed); Spark's own cast would also take Java forms such as "1d", "2f" or hex floats.
_NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def retry_after_seconds(retry_after="retry_after") -> Column:
    """Retry-After as seconds when it is a finite number >= 0; malformed, negative, NaN or infinite -> null.
    Text is read the way Python's ``float()`` reads it, so the closed form and the delivery loop agree."""
    c = F.col(retry_after) if isinstance(retry_after, str) else retry_after
    text = F.regexp_replace(c, r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r"(?<=[0-9])_(?=[0-9])", "")
    d = F.when(text.rlike(_NUMBER_TEXT), text.try_cast("double"))
    return F.when(d.isNotNull() & (d >= 0) & (d < F.lit(float("inf"))), d)


def backoff_seconds(attempt="attempt_no", retry_after="retry_after", base: float = 1.0,
                    cap: float = 60.0, jitter: Column | None = None) -> Column:
    """Wait before the next attempt: a valid Retry-After as is (uncapped), else
    ``min(cap, base * 2**attempt)`` plus jitter in [0, base) (none when ``jitter`` is None)."""
    a = F.col(attempt) if isinstance(attempt, str) else attempt
    expo = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), a.cast("double")))
    if jitter is not None:
        expo = expo + jitter * F.lit(float(base))
    return F.coalesce(retry_after_seconds(retry_after), expo)


def py_classify(status: int | None) -> str:
    if status is None:
        return RETRY
    if status < 300:
        return OK
    if status == 429 or 500 <= status < 600:
        return RETRY
    return FAIL


def py_retry_after(value) -> float | None:
    if value is None:
        return None
    text = str(value)
    if text.strip() == "":
        return None
    try:
        v = float(text)
    except ValueError:
        return None
    if math.isnan(v) or math.isinf(v) or v < 0:
        return None
    return v


def py_backoff(attempt: int, retry_after, base: float, cap: float, rng: random.Random | None) -> float:
    ra = py_retry_after(retry_after)
    if ra is not None:
        return ra
    wait = min(cap, base * (2 ** attempt))
    if rng is not None:
        wait += rng.uniform(0, base)
    return wait
