"""Delivery with retries.

``deliver`` is a ``mapInPandas`` stage: rows are spread over a bounded number of partitions by
account hash (never grouped by channel, so one busy channel cannot pin a third of all sends to
one task) and each task posts its rows one by one through an injected ``transport``, sleeping
through an injected ``sleep``. Every transport exception is caught per row, so a task never fails
after some of its sends. Evaluate the result in exactly one action (the ledger append).

``resolve_attempts`` is the same rule set as a closed form over a table of recorded responses,
with no I/O: aggregations per key, checkable against SQL.
"""

from __future__ import annotations

import datetime as dt
import json
import random
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acct_health.session import ship_package
from acct_health.functions.backoff import (
    FAIL,
    OK,
    RETRY,
    backoff_seconds,
    py_backoff,
    py_classify,
    response_class,
)

NO_RESPONSE = "no recorded response"


@dataclass(frozen=True)
class Request:
    """What a transport receives: target, JSON body, idempotency key, attempt number (from 0) and
    the input row as a dict (extra columns pass through to the transport)."""

    url: str
    body: str
    idempotency_key: str
    attempt: int
    row: dict


@dataclass(frozen=True)
class RetryPolicy:
    max_attempts: int = 5
    base_seconds: float = 1.0
    cap_seconds: float = 60.0
    jitter: bool = True


Transport = Callable[[Request], tuple]


def target_url(channel_col: str, base_url: str | None, single_url: str | None):
    """Base-URL mode ``{base}/{channel}`` wins over a single URL; neither raises here, on the driver (G1)."""
    if base_url:
        return F.concat(F.lit(base_url.rstrip("/") + "/"), F.col(channel_col))
    if single_url:
        return F.lit(single_url)
    raise ValueError("a run that posts needs webhook_base_url (one target a channel) or webhook_url (one for all)")


def http_transport(timeout: float = 10.0, headers: dict | None = None) -> Transport:
    """A plain HTTP POST transport (stdlib). Returns (status, response headers)."""
    extra = dict(headers or {})

    def post(req: Request):
        h = {"Content-Type": "application/json", "Idempotency-Key": req.idempotency_key, **extra}
        r = urllib.request.Request(req.url, data=req.body.encode("utf-8"), headers=h, method="POST")
        try:
            with urllib.request.urlopen(r, timeout=timeout) as resp:
                return resp.status, dict(resp.headers)
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers or {})

    return post


def replay_transport(responses_col: str = "responses") -> Transport:
    """Transport answering from recorded responses carried by the row
    (``array<struct<status:int, retry_after:string>>`` ordered by attempt); raises when they run out."""

    def answer(req: Request):
        recorded = req.row.get(responses_col)
        if recorded is None or req.attempt >= len(recorded):
            raise RuntimeError(NO_RESPONSE)
        item = recorded[req.attempt]
        status, retry_after = item["status"], item["retry_after"]
        return int(status), ({} if retry_after is None else {"Retry-After": retry_after})

    return answer


@dataclass(frozen=True)
class Response:
    """What one attempt brought: a status with its Retry-After text, or the error that came instead."""

    status: int | None
    retry_after: str | None = None
    error: str | None = None


def ask(transport: Transport, request: Request) -> Response:
    """One attempt. Header names count without case; any exception of the transport is an answer."""
    try:
        status, headers = transport(request)
        named = {str(k).lower(): v for k, v in dict(headers or {}).items()}
        return Response(int(status), named.get("retry-after"))
    except Exception as exc:
        return Response(None, error=str(exc))


def pause_after(attempt: int, response: Response, policy: RetryPolicy, rng: random.Random | None) -> float | None:
    """Seconds until the next attempt, None where this response is the last (the closed form's rule)."""
    if py_classify(response.status) != RETRY or attempt + 1 >= policy.max_attempts:
        return None
    return py_backoff(attempt, response.retry_after, policy.base_seconds, policy.cap_seconds, rng)


def result_of(responses: list[Response], waited: float) -> dict:
    """The result record (G5) of an alert's responses, the last of which was final."""
    if not responses:
        return dict(ok=False, status_code=None, attempts=0, error="no attempt allowed", waited_seconds=waited)
    end = responses[-1]
    kind = py_classify(end.status)
    error = end.error if end.status is None else f"HTTP {end.status}" + (" (non-retryable)" if kind == FAIL else "")
    seen = [r.status for r in responses if r.status is not None]
    return dict(ok=kind == OK, status_code=seen[-1] if seen else None, attempts=len(responses),
                error=None if kind == OK else error, waited_seconds=waited)


def send_with_retry(transport: Transport, url: str, body: str, key: str, row: dict,
                    policy: RetryPolicy, sleep: Callable[[float], None]) -> dict:
    """One alert until a response is final (G2-G5): ok, status_code, attempts, error, waited_seconds."""
    rng = random.Random(zlib.crc32(key.encode("utf-8"))) if policy.jitter else None
    responses: list[Response] = []
    pauses: list[float] = []
    while policy.max_attempts > 0:
        responses.append(ask(transport, Request(url, body, key, len(responses), row)))
        pause = pause_after(len(responses) - 1, responses[-1], policy, rng)
        if pause is None:
            break
        sleep(pause)
        pauses.append(pause)
    return result_of(responses, float(sum(pauses)))


RESULT_FIELDS = [
    T.StructField("ok", T.BooleanType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("attempts", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("waited_seconds", T.DoubleType()),
    T.StructField("sent_at", T.TimestampType()),
]


def deliver(df: DataFrame, transport: Transport, policy: RetryPolicy | None = None,
            base_url: str | None = None, single_url: str | None = None,
            key_cols: tuple = ("account_id", "month"), key_prefix: str = "",
            payload_col: str = "payload", channel_col: str = "channel",
            keep: tuple = ("account_id", "month", "channel"), partitions: int | None = None,
            sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Post every row's payload; output ``keep`` columns plus the result columns.

    The idempotency key ``{prefix}{key cols joined by '|'}`` goes to the transport so a receiver
    can drop repeats after a task retry (delivery itself is at-least-once).
    """
    if df.sparkSession.sparkContext.getConf().get("spark.speculation", "false").lower() == "true":
        raise ValueError("a delivery stage must not run with spark.speculation: a task run twice posts twice")
    policy = policy or RetryPolicy()
    url = target_url(channel_col, base_url, single_url)
    ship_package(df.sparkSession)
    key = F.concat_ws("|", F.lit(key_prefix), *[F.col(c).cast("string") for c in key_cols])
    inp = df.select(*df.columns, url.alias("_url"), key.alias("_key"))
    if partitions:
        inp = inp.repartition(partitions, *[F.col(c) for c in key_cols])
    inp = inp.sortWithinPartitions(*key_cols)  # each task posts in key order (C3)
    keep = tuple(keep)
    out_schema = T.StructType([inp.schema[c] for c in keep] + RESULT_FIELDS)
    cols = inp.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            results = []
            for rec in pdf.to_dict("records"):
                row = {c: rec[c] for c in cols if not c.startswith("_")}
                body = rec[payload_col]
                res = send_with_retry(transport, rec["_url"], body if isinstance(body, str) else json.dumps(body),
                                      rec["_key"], row, policy, sleep)
                res["sent_at"] = pd.Timestamp(dt.datetime.now(dt.timezone.utc)) if res["ok"] else None
                results.append({**{c: rec[c] for c in keep}, **res})
            frame = pd.DataFrame(results, columns=[f.name for f in out_schema.fields])
            frame["status_code"] = frame["status_code"].astype("Int32")
            frame["attempts"] = frame["attempts"].astype("Int64")
            yield frame

    return inp.mapInPandas(run, out_schema)


def attempt_grid(attempts: DataFrame, key: str = "user_id", max_attempts: int = 5) -> DataFrame:
    """Recorded attempts below ``max_attempts``; a key that neither ends nor reaches the limit gets its
    missing attempts as transport errors (null status), as a transport with no more answers behaves.

    One pass: window aggregates over the key (attempts per key are bounded by ``max_attempts``), and
    the last recorded row of such a key expands into itself plus the missing attempts.
    """
    att = attempts.where(F.col("attempt_no") < max_attempts).select(key, "attempt_no", "status", "retry_after")
    w = Window.partitionBy(key)
    last = F.max("attempt_no").over(w)
    terms = F.count(F.when(response_class("status") != RETRY, 1)).over(w)
    row = F.struct(F.col("attempt_no"), F.col("status"), F.col("retry_after"))
    fill = F.transform(
        F.sequence(F.col("attempt_no") + 1, F.lit(max_attempts - 1).cast("bigint")),
        lambda n: F.struct(n.alias("attempt_no"), F.lit(None).cast("int").alias("status"),
                           F.lit(None).cast("string").alias("retry_after")))
    grows = (F.col("_terms") == 0) & (F.col("attempt_no") == F.col("_last")) & (F.col("_last") < max_attempts - 1)
    rows = F.when(grows, F.concat(F.array(row), fill)).otherwise(F.array(row))
    return (att.withColumn("_last", last).withColumn("_terms", terms)
            .select(key, F.explode(rows).alias("_r"))
            .select(key, "_r.attempt_no", "_r.status", "_r.retry_after"))


def backoff_schedule(attempts: DataFrame, policy: RetryPolicy, key: str = "user_id") -> DataFrame:
    """Per attempt up to the terminal one: response class and the wait that follows it (null when
    none follows: success, non-retryable, or the last attempt). No jitter."""
    grid = attempt_grid(attempts, key, policy.max_attempts).withColumn("response_class", response_class("status"))
    first_terminal = F.min(F.when(F.col("response_class") != RETRY, F.col("attempt_no"))).over(Window.partitionBy(key))
    g = grid.withColumn("_term", first_terminal)
    last = F.coalesce(F.col("_term"), F.lit(policy.max_attempts - 1).cast("bigint"))
    wait = backoff_seconds("attempt_no", "retry_after", policy.base_seconds, policy.cap_seconds)
    return (g.where(F.col("attempt_no") <= last)
            .select(key, "attempt_no", "status", "response_class",
                    F.when((F.col("response_class") == RETRY) & (F.col("attempt_no") < last), wait)
                    .alias("wait_seconds")))


def resolve_attempts(attempts: DataFrame, policy: RetryPolicy, key: str = "user_id") -> DataFrame:
    """Final result per key from recorded responses (G6): ok, status_code, attempts, error and the
    total planned wait (no jitter), by the same rules as :func:`send_with_retry`."""
    sched = backoff_schedule(attempts, policy, key)
    last_struct = F.struct(F.col("attempt_no"), F.col("status"), F.col("response_class"))
    agg = sched.groupBy(key).agg(
        F.max(last_struct).alias("_end"),
        F.max(F.when(F.col("status").isNotNull(), F.struct("attempt_no", "status"))).alias("_seen"),
        F.coalesce(F.sum("wait_seconds"), F.lit(0.0)).alias("planned_wait_seconds"))
    end = F.col("_end")
    cls, st = end.getField("response_class"), end.getField("status")
    status_code = F.when(cls == RETRY, F.col("_seen").getField("status")).otherwise(st).cast("int")
    error = (F.when(cls == OK, F.lit(None).cast("string"))
             .when(cls == FAIL, F.concat(F.lit("HTTP "), st.cast("string"), F.lit(" (non-retryable)")))
             .when(st.isNull(), F.lit(NO_RESPONSE))
             .otherwise(F.concat(F.lit("HTTP "), st.cast("string"))))
    return agg.select(
        key,
        (cls == OK).alias("ok"),
        status_code.alias("status_code"),
        (end.getField("attempt_no") + 1).cast("bigint").alias("attempts"),
        error.alias("error"),
        F.col("planned_wait_seconds").cast("double").alias("planned_wait_seconds"))
