"""The ledger under crashes, concurrent runs and compaction."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from acct_health.operators.commits import LostClaim, commit_next, read_state, try_commit, vacuum
from acct_health.operators.intents import claim_states, read_unknown, record_wave, recover
from acct_health.operators.ledger import LOG_SCHEMA, append_log, compact_month, current_outcomes, read_log, read_replays
from acct_health.params import ALERT_TYPE
from acct_health.plans import run as run_module
from acct_health.plans.run import run_month

from tests.conftest import SAMPLE_ROWS, TARGET, FakeTransport, posts, row, write_rows


@pytest.fixture
def ledger(tmp_path):
    return str(tmp_path / "ledger")


def _many(tmp_path, n=24):
    """n more accounts at risk, all routable."""
    return "file://" + write_rows(tmp_path / "many.parquet", [
        row(f"acc{i:03d}", f"Name {i}", ["EMEA", "APAC"][i % 2], TARGET, "At Risk", None) for i in range(n)])


def _run(spark, source, ledger, params, transport=None, **options):
    return run_month(spark, source, TARGET, ledger, params, transport=transport or FakeTransport(200), sleep=lambda s: None, **options)


def _current(spark, ledger):
    return {r["account_id"]: (r["status"], r["run_id"]) for r in current_outcomes(read_log(spark, ledger, TARGET)).collect()}


class Crash(Exception):
    pass


def _crash_in_wave(monkeypatch, wave, written=True):
    """The run dies after the rows of a wave were written and before they are recorded (or before the write)."""
    plain_write, plain_record = run_module.write_entry, run_module.record_wave
    seen = []

    def write(rows, ledger_dir, entry):
        seen.append(entry)
        if not written and len(seen) == wave + 1:
            raise Crash
        plain_write(rows, ledger_dir, entry)

    def record(spark, ledger_dir, month, run_id, w, entry, seconds):
        if w == wave:
            raise Crash
        plain_record(spark, ledger_dir, month, run_id, w, entry, seconds)

    monkeypatch.setattr(run_module, "write_entry", write)
    monkeypatch.setattr(run_module, "record_wave", record)


def test_run_killed_after_a_wave_s_posts_posts_nothing_again(spark, params, ledger, tmp_path, monkeypatch):
    source, log = _many(tmp_path), str(tmp_path)
    waves = dataclasses.replace(params, delivery_waves=3)
    with monkeypatch.context() as m:
        _crash_in_wave(m, 1)
        with pytest.raises(Crash):
            _run(spark, source, ledger, waves, FakeTransport(200, log), run_id="dead")
    before = posts(log)
    claim = read_state(spark, ledger, TARGET).claims["dead"]
    states = {r["state"]: r["n"] for r in claim_states(spark, ledger, claim, LOG_SCHEMA).groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert set(states) == {"recorded", "salvaged", "never_posted"} and states["recorded"] + states["salvaged"] == len(before)
    _run(spark, source, ledger, waves, FakeTransport(200, log), run_id="again", take_over="dead")
    after = posts(log)
    assert len(after) == len(set(after)) == 24
    assert read_unknown(spark, ledger, TARGET).count() == 0
    assert all(s == "sent" for s, _ in _current(spark, ledger).values())


@pytest.mark.parametrize("policy", ["resend", "hold"])
def test_posts_without_a_record_are_listed_as_unknown(spark, params, ledger, tmp_path, monkeypatch, policy):
    source, log = _many(tmp_path), str(tmp_path)
    own = dataclasses.replace(params, delivery_waves=3, unknown_sends=policy)
    with monkeypatch.context() as m:
        _crash_in_wave(m, 1, written=False)
        with pytest.raises(Crash):
            _run(spark, source, ledger, own, FakeTransport(200, log), run_id="dead")
    # nothing is taken over while the dead run's claim lasts
    _run(spark, source, ledger, own, FakeTransport(200, log), run_id="early")
    first = posts(log)
    early = read_replays(spark, ledger).where("run_id = 'early'").groupBy("status").count().collect()
    assert {r["status"] for r in early} == {"claimed_elsewhere", "skipped_replay"}
    _run(spark, source, ledger, own, FakeTransport(200, log), run_id="late", take_over="dead")
    unknown = {r["account_id"] for r in read_unknown(spark, ledger, TARGET).collect()}
    sent = {a for a, (s, _) in _current(spark, ledger).items() if s == "sent"}
    assert unknown and len(posts(log)) == len(set(posts(log)))
    if policy == "resend":
        assert len(sent) == 24 and set(posts(log)) >= set(first)
    else:
        assert len(sent) == 24 - len(unknown) and not sent & unknown
        # the receiver's own records settle them
        rows = [("desk", 1 << 60, a, ALERT_TYPE, "x", "sent", None, None, None, 1, 200, None, TARGET) for a in sorted(unknown)]
        append_log(spark.createDataFrame(rows, LOG_SCHEMA), ledger, TARGET)
        _run(spark, source, ledger, own, FakeTransport(200, log), run_id="last")
        assert len(posts(log)) == len(sent) and all(s == "sent" for s, _ in _current(spark, ledger).values())


def test_interleaved_runs_send_each_key_once(spark, params, ledger, tmp_path):
    """A whole second run between the first one's decision and its commit."""
    from acct_health.plans.alerts import alerts_from_snapshot, routed_snapshot
    from acct_health.sources.account_month import month_window, read_account_month
    source, log = _many(tmp_path), str(tmp_path)
    alerts = alerts_from_snapshot(routed_snapshot(spark, month_window(read_account_month(spark, source), TARGET, 24), TARGET, params))
    done = []

    def other():
        if not done:
            done.append(_run(spark, source, ledger, params, FakeTransport(200, log), run_id="other"))

    totals = run_module.decide_and_deliver(spark, alerts, TARGET, ledger, params, FakeTransport(200, log), "mine", 1,
                                           sleep=lambda s: None, before_commit=other)
    assert (totals["alerts_sent"], totals["skipped_replay"]) == (0, 24)
    assert len(posts(log)) == len(set(posts(log))) == 24
    assert read_log(spark, ledger, TARGET).where("status = 'sent'").count() == 24


def test_a_run_that_lost_its_claim_stops(spark, params, ledger, tmp_path, monkeypatch):
    source = _many(tmp_path)
    plain = run_module.start_wave

    def start(spark_, ledger_dir, month, run_id, wave, entry, seconds):
        if wave == 1:
            assert recover(spark, ledger, TARGET, LOG_SCHEMA, ALERT_TYPE, lambda c: True) == ["slow"]
        plain(spark_, ledger_dir, month, run_id, wave, entry, seconds)

    with monkeypatch.context() as m:
        m.setattr(run_module, "start_wave", start)
        with pytest.raises(LostClaim):
            _run(spark, source, ledger, dataclasses.replace(params, delivery_waves=2), run_id="slow")
    with pytest.raises(LostClaim):
        record_wave(spark, ledger, TARGET, "slow", 1, "x", 1.0)


def test_commit_numbers_are_taken_once(spark, ledger):
    assert try_commit(spark, ledger, TARGET, 1, {"kind": "outcomes", "entry": "a"})
    assert not try_commit(spark, ledger, TARGET, 1, {"kind": "outcomes", "entry": "b"})
    commit_next(spark, ledger, TARGET, {"kind": "outcomes", "entry": "c"})
    state = read_state(spark, ledger, TARGET)
    assert (state.version, state.entries) == (2, ["a", "c"])


def _log(spark, n, run):
    rows = [(f"{run}", i, f"a{i % 7}", ALERT_TYPE, "x", "sent" if i % 5 == 3 else "failed", None, None, None, 1, 200, None, TARGET)
            for i in range(n)]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_compaction_keeps_the_view_and_reads_the_snapshot_only(spark, ledger):
    for run in ("r1", "r2", "r3"):
        append_log(_log(spark, 40, run), ledger, TARGET)
    view = lambda: sorted(tuple(r) for r in current_outcomes(read_log(spark, ledger, TARGET)).select("account_id", "seq", "run_id", "status").collect())
    before = view()
    assert compact_month(spark, ledger, TARGET) == 3 and compact_month(spark, ledger, TARGET) == 0
    assert view() == before and read_log(spark, ledger, TARGET).count() == 7
    append_log(_log(spark, 12, "r4"), ledger, TARGET)
    files = read_log(spark, ledger, TARGET).inputFiles()
    entries = read_state(spark, ledger, TARGET).entries
    assert len(entries) == 2 and {f.split("/")[-2] for f in files} == {e.split("/")[-1] for e in entries}
    assert vacuum(spark, ledger, TARGET) == 0 and vacuum(spark, ledger, TARGET, keep_seconds=0) == 3
    assert read_log(spark, ledger, TARGET).count() == 19
    append_log(_log(spark, 3, "r5"), ledger, TARGET)
    assert len(read_state(spark, ledger, TARGET).entries) == 3


def test_compaction_keeps_open_claims(spark, params, ledger, tmp_path, monkeypatch):
    source = _many(tmp_path)
    waves = dataclasses.replace(params, delivery_waves=3)
    _run(spark, "file://" + write_rows(tmp_path / "s.parquet", SAMPLE_ROWS), ledger, params)
    with monkeypatch.context() as m:
        _crash_in_wave(m, 1)
        with pytest.raises(Crash):
            _run(spark, source, ledger, waves, run_id="dead")
    before = vars(read_state(spark, ledger, TARGET).claims["dead"])
    assert compact_month(spark, ledger, TARGET) >= 2
    assert vars(read_state(spark, ledger, TARGET).claims["dead"]) == before
    _run(spark, source, ledger, waves, run_id="again", take_over="dead")
    current = _current(spark, ledger)
    assert sum(s == "sent" for s, _ in current.values()) == 26


def test_speculation_is_refused(spark, params, ledger, tmp_path, monkeypatch):
    from acct_health.operators.delivery import deliver
    frame = spark.createDataFrame([("a", TARGET, "x", "{}")], "account_id string, month date, channel string, payload string")
    real = spark.sparkContext.getConf()

    class Conf:
        def get(self, key, default=None):
            return "true" if key == "spark.speculation" else real.get(key, default)

    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: Conf())
    with pytest.raises(ValueError, match="speculation"):
        deliver(frame, FakeTransport(200), base_url="http://x")


def test_a_claim_without_sends_holds_nothing(spark, ledger):
    from acct_health.operators.commits import claimed_keys
    from acct_health.operators.intents import claim_sends
    sends = spark.createDataFrame([("a", "all", 0), ("b", "all", 1)], "account_id string, channel string, wave int")
    assert claim_sends(spark, ledger, TARGET, "none", sends.where("wave > 1"), 1, 1, 3600.0)
    held = lambda: sorted(r[0] for r in claimed_keys(spark, ledger, read_state(spark, ledger, TARGET)).collect())
    assert held() == []
    assert claim_sends(spark, ledger, TARGET, "some", sends, 2, 2, 3600.0)
    assert held() == ["a", "b"]
