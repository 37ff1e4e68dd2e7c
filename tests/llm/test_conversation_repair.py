"""Conversation repair against a forward search over (state, cheapest cost, least audit)."""

import hashlib
import random
import re
import zlib

import pytest

from acct_health.llm.conversation_repair import RESULT, damaged, op11_conversation_repair, repair

SMALL = "/root/testdata/sf0.001"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
BLANK = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def _mark(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def _repair(rows):
    """One conversation by a search from its start."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, _mark(r[2], r[3])))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    best = {"": (0, "", ())}

    def offer(into, state, value):
        if state is not None and (state not in into or value < into[state]):
            into[state] = value

    def inserts(best):
        out = dict(best)
        for state, (cost, audit, kept) in best.items():
            for n in range(1, 4):
                state = "u" if state != "u" else "a"
                kept = kept + ("user:" if state == "u" else "assistant:",)
                offer(out, state, (cost + 2 * n, audit + "I" * n, kept))
        return out

    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        late = fault == "truncated"
        for state, (cost, audit, kept) in inserts(best).items():
            offer(after, state, (cost + 3, audit + "D", kept))
            if fault not in ("blank", "duplicate"):
                offer(after, NEXT.get((state, role[:1])), (cost + late, audit + "K", kept + (f"{role}:{text}",)))
                for new in ("user", "assistant"):
                    offer(after, NEXT.get((state, new[0])), (cost + 2 + late, audit + "R", kept + (f"{new}:{text}",)))
        best = after
    cost, audit, kept = min(v for s, v in inserts(best).items() if s in ("", "a"))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest())


def _expected(rows):
    after = _damage(rows)
    return sorted([(c, *_repair([r for r in after if r[0] == c])) for c in {r[0] for r in rows}], key=str)


def _got(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=str)


def _rows(n, longest, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "What?", "", " \t", "Fine!", "Naïve …", "一.", None, "Fine! \n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Uma", "artist"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t + 3, None, 2])
            rows.append((rng.choice([c, c, c, c, None]) if c < 3 else c, turn, rng.choice(roles), rng.choice(texts)))
    return rows + rows[:5]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_short_conversations(spark, seed):
    rows = _rows(150, 12, seed)
    assert _got(repair(damaged(spark.createDataFrame(rows, SCHEMA)))) == _expected(rows)


def test_long_conversations_in_segments(spark):
    rows = _rows(12, 60, 3) + [(77, t % 9, "user", "Same.") for t in range(200)] + [(78, 1, "system", "Alone.")] * 90
    got = repair(damaged(spark.createDataFrame(rows, SCHEMA)), long_rows=7, segment_rows=3)
    assert _got(got) == _expected(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(op11_conversation_repair(spark, SMALL)) == _expected(rows)


def test_dropped_rows_and_empty_table(spark):
    gone = [(c, t, "user", "x.") for c in range(400) for t in [5] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    rows = _got(repair(damaged(spark.createDataFrame(gone, SCHEMA))))
    assert rows and all(r[1:8] == (0, 0, 0, 0, 0, 0, "") and r[8] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert repair(damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_clashing_columns_and_long_text(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "end."), (1, 1, "assistant", "Yes.")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", n long, audit string, mark string")
    assert _got(repair(damaged(df))) == _expected(rows)
