"""Prefix trie against a plain trie of tuples."""

import hashlib
import random
import zlib

import pytest

from acct_health.llm.prefix_trie import ORACLE_SQL, SpillingQueue, op13_prefix_trie, prefix_trie
from tests.llm.test_conversation_repair import SCHEMA, _mark
from tools.oracle_check import duck

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _expected(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, _mark(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(r)] for c, r in own.items()}
    whole = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        whole[c] = tuple(own.get(c - base, [])[:h] + s[h:])
    nodes = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    total = {}
    for p in sorted(nodes, key=len, reverse=True):
        kids = children.get(p, [])
        leaves = sum(total[k][0] for k in kids) if kids else 1
        total[p] = (leaves, sum(total[k][1] for k in kids) + (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0))
    return sorted([(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *total[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == p).encode()).hexdigest())
                   for p, m in nodes.items()], key=str)


def _got(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=str)


def _rows(seed, n=260):
    rng = random.Random(seed)
    texts = ["Hello.", "Hi", "", None, "日本 é", "Ok?"]
    rows = [(c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(texts))
            for c in rng.sample(range(-150, 700), n) for t in range(rng.randint(1, 8))]
    return rows + rows[:9] + [(None, 1, "user", "x"), (4000, 0, "user", "only")]


@pytest.mark.parametrize(("long_rows", "shard_convs", "shard_depth", "queue_rows"), [(4096, 1000, 1 << 16, 1 << 16), (5, 20, 2, 2)])
def test_against_a_plain_trie(spark, long_rows, shard_convs, shard_depth, queue_rows):
    rows = _rows(long_rows)
    if long_rows == 5:  # copies of a long conversation, and one turn many times
        rows += [(c, t, "user", f"turn {t}") for c in (900, 901, 907) for t in range(40)] + [(950, 1, "user", "again")] * 30
    df = spark.createDataFrame([(*r, 1, "m") for r in rows], SCHEMA + ", depth long, mark string")
    assert _got(prefix_trie(df, long_rows, shard_convs, shard_depth, queue_rows)) == _expected(rows)


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    plain = _expected([tuple(r) for r in rows])
    assert _got(op13_prefix_trie(spark, SMALL)) == plain
    sql = duck(SMALL).execute(ORACLE_SQL).fetchall()
    assert sorted([tuple(r) for r in sql], key=str) == plain


def test_queue_spills_and_keeps_its_order():
    rng = random.Random(2)
    queue, out = SpillingQueue(7), []
    keys = [(rng.randrange(40), rng.randrange(5)) for _ in range(500)]
    for i, k in enumerate(keys):
        queue.push(k, i)
        if i % 9 == 8:
            out.append(queue.pop())
    least = queue.first()
    rest = []
    while queue.first() is not None:
        rest.append(queue.pop())
    queue.close()
    assert rest[0][0] == least and [e[0] for e in rest] == sorted(e[0] for e in rest)
    assert sorted(e[2][0] for e in out + rest) == list(range(500))
