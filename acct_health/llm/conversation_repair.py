"""Conversation structure repair: the cheapest edits that make role initials read ``(s?(ua)+)?``.

A conversation is a lattice of nodes (row, state of the grammar). Keep and Rerole consume a row and
step the grammar, Delete consumes a row, Insert steps the grammar. A cost DP from the end gives every
node's cheapest cost; arcs that attain it are optimal. The audit, the edits' initials, is the
ASCII-least one on optimal arcs. It is found by prefix doubling: nodes are ranked by the next letter of
their least audit, then by the next 2, 4, 8 ... letters, where the rank for 2k letters is that of the
pair (rank for k letters, rank of the node k letters further), and the pointers to that node double
too. A letter and a node determine the next node, so each node has one pointer. All conversations of an
Arrow batch are ranked together. The path is read off the doubled pointers.

Conversations of over ``long_rows`` rows are cut into segments (``ordered_rows``). Costs pass over a
segment as a min-plus matrix between grammar states, so its nodes' costs need only those of the segments
after it; each segment gives its least audit for every state it can be entered in. Only the last step
reads a long conversation's segments in a row, one at a time, since a SHA-256 is sequential.

Defined results: a null role or text is one space; in the damage key a null id or turn is one space.
Rows of one turn are ordered by the SHA-256 of role and text. A role whose initial is not s, u or a
(the empty one too) can't be kept. Rows with a null ``conv_id`` are one conversation with that id. An empty table gives no
rows. Other columns of the input are not read. Repeated input rows are rows like any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acct_health.llm.common import read_table, stored
from acct_health.llm.ordered_rows import LONG_ROWS, PLACE, in_order, long_segments, row_mark, sizes, split

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar states: 0 nothing read, 1 after s, 2 after u, 3 after a. Initials: 0 s, 1 u, 2 a, 3 any other.
STATES = 4
_STEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: Where an inserted or re-roled row leads: user unless a user's turn is open.
_TURN = np.array([2, 2, 3, 2])
#: What the end costs in each state: inserts up to a whole number of pairs.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_FAR = np.int64(1) << 60
_LETTERS = "\0DIKR"
_BLANK = " \t\n\x0b\x0c\r"
RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")


def row_code(role: str, text: str, again: bool) -> int:
    """A row in one byte: its initial, 4 if it has to go (8 blank, 16 duplicate), 32 if truncated."""
    code = "sua".find(role[:1]) if role else 3
    code = 3 if code < 0 else code
    bare = text.strip(_BLANK)
    if not bare:
        return code | 4 | 8
    if again:
        return code | 4 | 16
    return code if bare[-1] in ".!?" else code | 32


class Lattice:
    """Costs and least audits of segments laid end to end. ``first`` has each segment's first row and the
    number of rows at its end; ``ends`` the costs after each segment by state; ``final`` the segments
    after which inserts may follow."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, ends: np.ndarray, final: np.ndarray):
        n = len(first) - 1
        length = np.diff(first)
        self.first = first[:-1] + np.arange(n)  # node rows: one more per segment than rows
        last = self.first + length
        cost = np.full((len(codes) + n, STATES), _FAR, np.int64)
        cost[last] = ends
        node = np.arange(len(codes) + n)
        is_row = np.ones(len(node), bool)
        is_row[last] = False
        initial = np.full(len(node), 3)
        initial[is_row] = codes & 3
        gone, extra = np.zeros(len(node), bool), np.zeros(len(node), np.int64)
        gone[is_row] = (codes & 4) > 0
        extra[is_row] = np.where(codes & 32, TRUNCATED, 0)
        step = _STEP[:, initial].T  # target state if kept
        order = np.argsort(-length, kind="stable")
        active = n
        for back in range(1, int(length.max(initial=0)) + 1):
            while active and length[order[active - 1]] < back:
                active -= 1
            at = last[order[:active]] - back
            after = cost[at + 1]
            own = after + DELETE
            stay = np.where(gone[at], _FAR, extra[at])[:, None]
            own = np.minimum(own, after[:, _TURN] + REROLE + stay)
            s = step[at]
            kept = np.take_along_axis(after, np.maximum(s, 0), 1) + KEEP + stay
            own = np.minimum(own, np.where(s >= 0, kept, _FAR))
            user, assistant = own[:, 2].copy(), own[:, 3].copy()
            own[:, 2] = np.minimum(user, assistant + INSERT)
            own[:, 3] = np.minimum(assistant, user + INSERT)
            own[:, :2] = np.minimum(own[:, :2], own[:, 2:3] + INSERT)
            cost[at] = np.minimum(own, _FAR)
        self.cost, self.last = cost, last
        # optimal arcs, the least letter of each node first: D, I, K, R
        here = node[:, None] * STATES + np.arange(STATES)
        letter, target = np.zeros(cost.shape, np.int64), here.copy()
        after = np.vstack([cost[1:], np.full((1, STATES), _FAR)])
        row, free = is_row[:, None], (is_row & ~gone)[:, None]
        may_insert = is_row.copy()
        may_insert[last[final]] = True
        nexts = (node + 1)[:, None] * STATES
        arcs = [(4, free & (after[:, _TURN] + REROLE + extra[:, None] == cost), nexts + _TURN),
                (3, free & (step >= 0) & (np.take_along_axis(after, np.maximum(step, 0), 1) + KEEP + extra[:, None] == cost),
                 nexts + np.maximum(step, 0)),
                (2, may_insert[:, None] & (cost[:, _TURN] + INSERT == cost), node[:, None] * STATES + _TURN),
                (1, row & (after + DELETE == cost), nexts + np.arange(STATES))]
        for code, optimal, to in arcs:
            letter, target = np.where(optimal, code, letter), np.where(optimal, to, target)
        self.letter = letter.ravel()
        self.jumps = [target.ravel()]
        rank = self.letter
        while not np.array_equal(near := self.jumps[-1], far := near[near]):
            _, rank = np.unique(rank * (rank.max() + 1) + rank[near], return_inverse=True)
            self.jumps.append(far)
        self.rank = rank

    def least(self, segments: np.ndarray, states: np.ndarray) -> list[tuple[str, int]]:
        """(audit, state after it) of the least path from each segment's first row in the given state.

        Starts of one rank have one audit, which is read once, off the doubled pointers."""
        start = self.first[segments] * STATES + states
        _, one, which = np.unique(self.rank[start], return_index=True, return_inverse=True)
        heads = start[one]
        level = np.zeros(len(heads), int)  # 2 ** level letters hold the audit
        for k, jump in enumerate(self.jumps):
            level[jump[jump[heads]] != jump[heads]] = k + 1
        audits = [""] * len(heads)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            path = heads[own][:, None]
            for jump in reversed(self.jumps[:k]):
                path = np.stack([path, jump[path]], 2).reshape(len(own), -1)
            for i, letters in zip(own.tolist(), self.letter[path], strict=True):
                audits[i] = "".join(_LETTERS[c] for c in letters[letters > 0])
        ends = self.jumps[-1][start] % STATES
        return [(audits[i], s) for i, s in zip(which.tolist(), ends.tolist(), strict=True)]


class Repaired:
    """One conversation's result, its segments added in their order."""

    def __init__(self):
        self.turns, self.low, self.high, self.before = 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.initial, self.state, self.audit = None, 0, []
        self.hash, self.begun = hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.begun = True

    def add(self, turns: list, roles: list[str], texts: list[str], codes: list[int], audit: str, state: int) -> None:
        for t in turns:
            if t is not None and t != self.before:
                self.turns += 1
                self.low = t if self.low is None else self.low
                self.high = self.before = t
        for code, role in zip(codes, roles, strict=True):
            self.blank += code >> 3 & 1
            self.duplicate += code >> 4 & 1
            self.truncated += code >> 5 & 1
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
        i, q = 0, self.state
        for letter in audit:
            if letter == "D":
                self.cost += DELETE
            elif letter == "K":
                self.cost += KEEP + (TRUNCATED if codes[i] & 32 else 0)
                q = int(_STEP[q, codes[i] & 3])
                self._write(roles[i], texts[i])
            else:
                q = int(_TURN[q])
                self._write("user" if q == 2 else "assistant", texts[i] if letter == "R" else "")
                self.cost += REROLE + (TRUNCATED if codes[i] & 32 else 0) if letter == "R" else INSERT
            i += letter != "I"
        self.state = state
        self.audit.append(audit)

    def row(self, conv_id) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


_LONG = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SCHEMA = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _LONG], ("audit", pa.string()),
                     ("repaired_sha256", pa.string())])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order -> results; whole conversations of a batch are solved together."""
    convs: list = []  # (conv_id, turns, roles, texts, codes); the last one may go on
    seen: set = set()
    started = False
    for b in batches:
        for c, turn, role, text, mark, copies in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if not started or c != convs[-1][0]:
                convs.append((c, [], [], [], []))
                seen, started = set(), True
            _, turns, roles, texts, codes = convs[-1]
            for _ in range(copies):
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                codes.append(row_code(role, text, mark in seen))
                seen.add(mark)
        if len(convs) > 1:
            yield _solve(convs[:-1])
            convs = convs[-1:]
    if convs:
        yield _solve(convs)


def _solve(convs: list) -> pa.RecordBatch:
    first = np.cumsum([0] + [len(c[1]) for c in convs])
    codes = np.array([x for c in convs for x in c[4]], np.int64)
    n = len(convs)
    lattice = Lattice(codes, first, np.broadcast_to(END, (n, STATES)), np.ones(n, bool))
    paths = lattice.least(np.arange(n), np.zeros(n, np.int64))
    out = []
    for (conv_id, turns, roles, texts, own), (audit, state) in zip(convs, paths, strict=True):
        r = Repaired()
        r.add(turns, roles, texts, own, audit, state)
        out.append(r.row(conv_id))
    return pa.RecordBatch.from_pylist(out, _SCHEMA)


def _record(conv, part: int, segment: int, **more: list) -> pa.RecordBatch:
    place = [pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([segment], pa.int64())]
    return pa.RecordBatch.from_arrays([*place, *[pa.array([x]) for x in more.values()]], [*PLACE, *more])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost of every segment from each entry state to each exit state (entry-major)."""
    for b in batches:
        for conv, part, segment, codes in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            unit = np.where(np.eye(STATES, dtype=bool), 0, _FAR)
            first = np.arange(STATES + 1) * len(codes)
            x = Lattice(np.tile(np.array(codes, np.int64), STATES), first, unit, np.zeros(STATES, bool))
            # run q of the tile has the costs to exit q; its first node those of every entry
            yield _record(conv, part, segment, matrix=x.cost[x.first].T.ravel().tolist())


def _ends(key: tuple, table: pa.Table) -> pa.Table:
    """Costs after every segment of one conversation (16 numbers a segment; a conversation has no more
    segments than its audit, one string, has letters / LONG_ROWS)."""
    table = table.sort_by([("part", "ascending"), ("segment", "ascending")])
    ends, cost = [], END
    for m in reversed(table.column("matrix").to_pylist()):
        ends.append(cost.tolist())
        cost = np.minimum((np.array(m).reshape(STATES, STATES) + cost).min(1), _FAR)
    ends.reverse()
    final = [False] * (len(ends) - 1) + [True]
    return table.drop_columns(["matrix"]).append_column("ends", pa.array(ends, pa.list_(pa.int64()))) \
                .append_column("final", pa.array(final))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least audit and exit of every segment for each state it may be entered in."""
    for b in batches:
        for conv, part, segment, codes, ends, final in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            x = Lattice(np.array(codes, np.int64), np.array([0, len(codes)]), np.array([ends]), np.array([final]))
            paths = x.least(np.zeros(STATES, np.int64), np.arange(STATES))
            yield _record(conv, part, segment, audits=[a for a, _ in paths], exits=[s for _, s in paths])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of long conversations in order -> results."""
    conv, now = None, None
    for b in batches:
        for r in b.to_pylist():
            if now is None or r["conv_id"] != conv:
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now.row(conv)], _SCHEMA)
                conv, now = r["conv_id"], Repaired()
            s = now.state
            now.add(r["turns"], r["roles"], r["texts"], r["codes"], r["audits"][s], r["exits"][s])
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row(conv)], _SCHEMA)


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = [[row_code(*x) for x in zip(*r, strict=True)] for r in
                 zip(b.column("roles").to_pylist(), b.column("texts").to_pylist(), b.column("repeats").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.select(PLACE).columns, pa.array(codes, pa.list_(pa.int64()))], [*PLACE, "codes"])


_PLACE = "conv_id long, part int, segment long"


def _at(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join of two tables of segments."""
    named = right.select(*[F.col(c).alias(f"__{c}") if c in PLACE else F.col(c) for c in right.columns])
    same = [left[c] == named[f"__{c}"] for c in PLACE[1:]]
    return left.join(named, [left["conv_id"].eqNullSafe(named["__conv_id"]), *same]).drop(*[f"__{c}" for c in PLACE])


def _repair_long(rows: DataFrame, n_rows: int, segment_rows: int) -> DataFrame:
    segments = long_segments(rows, n_rows, segment_rows)
    codes = stored(segments.mapInArrow(_codes, f"{_PLACE}, codes array<long>"), "codes")
    matrices = codes.mapInArrow(_matrices, f"{_PLACE}, matrix array<long>")
    ends = matrices.groupBy("conv_id").applyInArrow(_ends, f"{_PLACE}, ends array<long>, final boolean")
    variants = _at(codes, ends).select(*PLACE, "codes", "ends", "final") \
        .mapInArrow(_variants, f"{_PLACE}, audits array<string>, exits array<long>")
    whole = _at(_at(segments, codes), variants).repartition("conv_id").sortWithinPartitions(*PLACE)
    return whole.mapInArrow(_fold, RESULT)


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, segment_rows: int = LONG_ROWS) -> DataFrame:
    """Result rows (``RESULT``) of conversations given as rows with conv_id, turn, role, text and copies (0: the row
    is gone, but its conversation is named; 2: it stands there twice). Role and text are not null."""
    own = rows.select("conv_id", "turn", "role", "text", row_mark(F.col("role"), F.col("text")).alias("mark"), "copies")
    counted = sizes(rows)
    short, long = split(own, counted, long_rows)
    out = in_order(short.where("copies > 0")).mapInArrow(_short, RESULT)
    empty = [F.lit(0).cast("long").alias(c) for c in _LONG]
    out = out.unionByName(counted.where("n = 0").select("conv_id", *empty, F.lit("").alias("audit"),
                                                        F.sha2(F.lit(""), 256).alias("repaired_sha256")))
    if long is not None:
        n = counted.where(F.col("n") > long_rows).agg(F.sum("n")).first()[0]
        out = out.unionByName(_repair_long(long, n, segment_rows))
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with one fault in four rows, chosen by crc32 of conversation and turn."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"),
                                F.coalesce("text", blank).alias("text"), F.pmod(F.crc32(key), F.lit(20)).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
                       .cast("long").alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages every conversation and repairs it: one row per conversation."""
    return repair(damaged(read_table(spark, sf_dir, "conversations")))


# crc32 of the key bit by bit, then a search over (conversation, rows read, state of the grammar) that keeps the
# cheapest cost and least audit of each, with up to two inserts before every row and at the end.
ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
        lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)),
          lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END)),
        4294967295::BIGINT) % 20 AS f
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed
), marked AS (
  SELECT *, sha256(length(role) || ':' || role || ':' || text) AS mark,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
), placed AS (
  SELECT *, i > min(i) OVER (PARTITION BY conv_id, mark) AS again FROM (
    SELECT conv_id, turn, role, text, mark, bare, left(role, 1) AS initial,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS i
    FROM marked)
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated'
    ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS wrong
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (wrong) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'kept': []::VARCHAR[]} AS b FROM counts
  UNION ALL
  SELECT conv_id, i, q, min(b) AS b FROM (
    SELECT conv_id, i, CASE e WHEN 'D' THEN q WHEN 'R' THEN CASE q WHEN 2 THEN 3 ELSE 2 END
        ELSE CASE WHEN initial = 's' AND q = 0 THEN 1 WHEN initial = 'u' AND q <> 2 THEN 2 WHEN initial = 'a' AND q = 2 THEN 3 END END AS q,
      {'cost': cost + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + (CASE WHEN e <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END),
       'audit': audit || e,
       'kept': CASE e WHEN 'D' THEN kept WHEN 'K' THEN list_append(kept, role || ':' || text)
               ELSE list_append(kept, CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || text) END} AS b
    FROM (
      SELECT r.conv_id, r.i, r.role, r.text, r.initial, r.fault, unnest(['D', 'K', 'R']) AS e,
        CASE x.k WHEN 0 THEN a.q WHEN 1 THEN CASE a.q WHEN 2 THEN 3 ELSE 2 END ELSE CASE a.q WHEN 2 THEN 2 ELSE 3 END END AS q,
        a.b.cost + 2 * x.k AS cost, a.b.audit || repeat('I', x.k) AS audit,
        CASE x.k WHEN 0 THEN a.b.kept WHEN 1 THEN list_append(a.b.kept, CASE a.q WHEN 2 THEN 'assistant:' ELSE 'user:' END)
          ELSE list_concat(a.b.kept, CASE a.q WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END) END AS kept
      FROM best a JOIN judged r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.i = a.i + 1, (SELECT unnest([0, 1, 2]) AS k) x
    ) WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate')
  ) WHERE q IS NOT NULL GROUP BY conv_id, i, q
), ended AS (
  SELECT a.conv_id, min({'cost': a.b.cost + CASE a.q WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END,
    'audit': a.b.audit || CASE a.q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'kept': CASE a.q WHEN 1 THEN list_concat(a.b.kept, ['user:', 'assistant:']) WHEN 2 THEN list_append(a.b.kept, 'assistant:')
            ELSE a.b.kept END}) AS b
  FROM best a JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id AND c.n = a.i GROUP BY a.conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(e.b.cost, 0) AS cost,
  coalesce(e.b.audit, '') AS audit, sha256(coalesce(array_to_string(e.b.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
