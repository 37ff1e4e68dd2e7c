"""Conversation prefix trie: shared beginnings of conversations, with totals of every subtree.

* A node is a distinct sequence of turns. Turns are hashed (SHA-256 of role and text), and a sequence is a
  polynomial of its turns' hashes modulo 2^127 - 1, so a piece of a long conversation continues where the
  piece before it ends without reading it: each piece is a multiplier and an offset.
* The smallest member and the depth name a node: the nodes of one smallest member are a path that goes
  down from where it branches off.
* Subtree totals by time-forward processing. Nodes are dealt over shards of ``SHARD_CONVS`` conversation
  ids by ``SHARD_DEPTH`` levels; Spark's external sort puts each shard's nodes in reverse level order.
  A node takes the totals sent to it from a priority queue, adds its own, and sends the sum to its parent
  through the queue, which holds ``QUEUE_ROWS`` in memory and spills sorted runs. What a shard's roots send to parents in
  other shards is added up by parent and processed the same way in those shards, until no shard root has
  a parent left. Such a later round reads only the shards that got something. Totals are sums, so a node's
  total is the sum of what the rounds found. The number of rounds is the longest chain of shards from a
  node to the root, not the depth of the trie.
* The SHA-256 of a node's ends is sequential; ids are sorted over range partitions and sent as chunks of
  ``CHUNK`` ids, so that only the hashing itself is one task's, one chunk at a time.

Defined results: rows with a null ``conv_id`` take no part. Null roles and texts are empty. Rows of one
turn are ordered by the SHA-256 of role and text; repeated rows are turns like any others. An empty table
gives no rows (no root either). Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acct_health.llm.common import read_table, stored
from acct_health.llm.ordered_rows import LONG_ROWS, long_segments, row_mark, sizes, split

#: A shard of the trie: so many conversation ids by so many levels.
SHARD_CONVS = 1000
SHARD_DEPTH = 1 << 16
QUEUE_ROWS = 1 << 16
CHUNK = 1 << 14

_P = (1 << 127) - 1
_B = 0x5DEECE66D1B3F29A7C15E6D9A1F0C3B7
ROOT = bytes(16)


# --- rebuilt conversations -----------------------------------------------------------------------

def _item(role: Column, text: Column) -> Column:
    return F.struct(row_mark(role, text).alias("mark"), F.length(text).cast("long").alias("chars"))


def sequences(conversations: DataFrame, long_rows: int = LONG_ROWS) -> tuple[DataFrame, DataFrame]:
    """((conv_id, start, items), (conv_id, n)): turns in order, long conversations as several rows."""
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(1).cast("long").alias("copies"))
    counted = sizes(rows)
    short, long = split(rows, counted, long_rows)
    ordered = F.sort_array(F.collect_list(F.struct("turn", _item(F.col("role"), F.col("text")).alias("item"))))
    out = short.groupBy("conv_id").agg(ordered.alias("x")).select("conv_id", F.lit(0).cast("long").alias("start"),
                                                                  F.col("x.item").alias("items"))
    if long is not None:
        n = counted.where(F.col("n") > long_rows).agg(F.sum("n")).first()[0]
        cut = long_segments(long.withColumn("mark", row_mark(F.col("role"), F.col("text"))), n, long_rows)
        before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part", "segment")) - F.col("n")
        places = cut.select("conv_id", "part", "segment", F.size("turns").cast("long").alias("n")).withColumn("start", before)
        items = F.transform(F.arrays_zip("roles", "texts"), lambda r: _item(r["roles"], r["texts"]))
        out = out.unionByName(cut.join(places, ["conv_id", "part", "segment"]).select("conv_id", "start", items.alias("items")))
    return stored(out, "sequences"), counted


def opening(conv_id: Column) -> Column:
    """How many turns a conversation takes over from its base."""
    return F.pmod(F.crc32(conv_id.cast("string")), F.lit(6)).cast("long")


def rebuilt(conversations: DataFrame, long_rows: int = LONG_ROWS) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, total, items), (conv_id, total)): every conversation with its base's first turns in place of
    its own; ``depth`` turns come before a row's items, ``total`` is the whole conversation's."""
    seq, counted = sequences(conversations, long_rows)
    base = F.col("conv_id") - F.col("conv_id") % 100
    first = seq.where((F.col("conv_id") % 100 == 0) & (F.col("start") < 5)) \
        .select("conv_id", "start", F.posexplode(F.slice("items", 1, 5)).alias("i", "item")) \
        .where(F.col("start") + F.col("i") < 5)
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("start") + F.col("i")).alias("at"), "item"))).alias("x")) \
        .select("base", F.col("x.item").alias("head"))
    own = counted.select("conv_id", "n", base.alias("base"), opening(F.col("conv_id")).alias("h"))
    known = own.join(heads, "base", "left").select(
        "conv_id", "h", F.coalesce(F.expr("slice(head, 1, int(h))"), F.expr("slice(head, 1, 0)"), F.array().cast(heads.schema["head"].dataType))
        .alias("head"), "n")
    total = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    known = stored(known.withColumn("total", total.cast("long")), "openings")
    rest = F.expr("slice(items, int(greatest(h - start, 0)) + 1, size(items))")
    pieces = seq.join(known, "conv_id").select(
        "conv_id", F.when(F.col("start") == 0, 0).otherwise(F.size("head") + F.greatest(F.col("start") - F.col("h"), F.lit(0)))
        .cast("long").alias("depth"), "total",
        F.when(F.col("start") == 0, F.concat("head", rest)).otherwise(rest).alias("items"))
    return pieces.where(F.size("items") > 0), known.select("conv_id", "total")


# --- nodes ---------------------------------------------------------------------------------------

def _number(mark: bytes) -> int:
    return int.from_bytes(mark[:16], "big") % _P


def _affine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a piece does to the hash of the turns before it: x -> mult * x + add."""
    for b in batches:
        rows = {"conv_id": b.column("conv_id"), "depth": b.column("depth")}
        mult, add = [], []
        for items in b.column("items").to_pylist():
            h = 0
            for x in items:
                h = (h * _B + _number(x["mark"])) % _P
            mult.append(pow(_B, len(items), _P).to_bytes(16, "big"))
            add.append(h.to_bytes(16, "big"))
        yield pa.RecordBatch.from_pydict(rows | {"mult": pa.array(mult), "add": pa.array(add)})


def _entries(key: tuple, table: pa.Table) -> pa.Table:
    """Hash at which each piece of one long conversation begins (one row a piece)."""
    table = table.sort_by("depth")
    h, out = 0, []
    for m, a in zip(table.column("mult").to_pylist(), table.column("add").to_pylist(), strict=True):
        out.append(h.to_bytes(16, "big"))
        h = (int.from_bytes(m, "big") * h + int.from_bytes(a, "big")) % _P
    return table.select(["conv_id", "depth"]).append_column("entry", pa.array(out))


MEMBER = "conv_id long, depth long, id binary, parent binary, chars long, last boolean"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every node that a piece passes."""
    for b in batches:
        conv, depth, ids, parents, chars, last = [], [], [], [], [], []
        for c, d, total, items, entry in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            h, at = int.from_bytes(entry, "big"), entry
            for x in items:
                h = (h * _B + _number(x["mark"])) % _P
                d += 1
                conv.append(c)
                depth.append(d)
                parents.append(at)
                at = h.to_bytes(16, "big")
                ids.append(at)
                chars.append(x["chars"])
                last.append(d == total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(ids, pa.binary()), pa.array(parents, pa.binary()),
             pa.array(chars, pa.int64()), pa.array(last, pa.bool_())], ["conv_id", "depth", "id", "parent", "chars", "last"])


def members(pieces: DataFrame) -> DataFrame:
    """(conv_id, depth, id, parent, chars, last): every conversation at every node but the root that it passes."""
    pieces = stored(pieces, "pieces")
    long = pieces.where("depth + size(items) < total or depth > 0")
    entries = long.select("conv_id", "depth", "items").mapInArrow(_affine, "conv_id long, depth long, mult binary, add binary") \
        .groupBy("conv_id").applyInArrow(_entries, "conv_id long, depth long, entry binary")
    begun = pieces.join(entries, ["conv_id", "depth"], "left") \
        .select("conv_id", "depth", "total", "items", F.coalesce("entry", F.lit(ROOT)).alias("entry"))
    return begun.mapInArrow(_members, MEMBER)


# --- subtree totals ------------------------------------------------------------------------------

class SpillingQueue:
    """A priority queue of (key, values) that keeps ``rows`` entries in memory. Beyond, its entries go to an unnamed
    file of the task as a sorted run; a run is read back a block at a time, as its entries are due."""

    def __init__(self, rows: int = QUEUE_ROWS):
        self.rows, self.heap, self.runs, self.tie = rows, [], [], itertools.count()
        self.file = None

    def push(self, key: tuple, *values: int) -> None:
        if len(self.heap) >= self.rows:
            self._spill()
        heapq.heappush(self.heap, (key, next(self.tie), values))

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.heap.sort()
        blocks = []
        step = max(1, self.rows // 16)
        self.file.seek(0, 2)
        for i in range(0, len(self.heap), step):
            blocks.append(self.file.tell())
            pickle.dump(self.heap[i:i + step], self.file)
        run = self._read(blocks)
        heapq.heappush(self.runs, (next(run), len(self.runs), run))
        self.heap = []

    def _read(self, blocks: list[int]):
        for at in blocks:
            self.file.seek(at)
            yield from pickle.load(self.file)

    def first(self) -> tuple | None:
        """The least key, None when empty."""
        heads = ([self.heap[0][0]] if self.heap else []) + ([self.runs[0][0][0]] if self.runs else [])
        return min(heads) if heads else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            entry, number, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))
            return entry
        return heapq.heappop(self.heap)

    def close(self) -> None:
        if self.file:
            self.file.close()


SENT = "conv_id long, depth long, n_leaves long, saved_tokens long, to_conv long"
_SENT = pa.schema([(c.split()[0], pa.int64()) for c in SENT.split(", ")])


def _forward(shard_convs: int, shard_depth: int, queue_rows: int):
    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, None
        for b in batches:
            out = []
            for c, d, parent, leaves, saved in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                own = (c // shard_convs, d // shard_depth)
                if own != shard:
                    if queue:
                        queue.close()
                    shard, queue = own, SpillingQueue(queue_rows)
                while queue.first() == (-d, c):
                    _, _, (more, tokens) = queue.pop()
                    leaves, saved = leaves + more, saved + tokens
                if not leaves and not saved:
                    continue
                inside = parent is not None and (parent // shard_convs, (d - 1) // shard_depth) == shard
                if inside:
                    queue.push((1 - d, parent), leaves, saved)
                out.append((c, d, leaves, saved, None if inside else parent))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=_SENT)
        if queue:
            queue.close()

    return forward


def subtree_totals(nodes: DataFrame, shard_convs: int = SHARD_CONVS, shard_depth: int = SHARD_DEPTH,
                   queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) summed over each node's subtree.

    ``nodes`` has a node's name (conv_id, depth), its parent's conv_id (null for a root) and its own n_leaves and
    saved_tokens."""
    units = [F.floor(F.col("conv_id") / shard_convs).alias("unit_c"), F.floor(F.col("depth") / shard_depth).alias("unit_d")]
    placed = nodes.select("conv_id", "depth", "parent_conv_id", "n_leaves", "saved_tokens", *units)
    kept = stored(placed, "trie")
    own, rounds = kept, []
    while True:
        dealt = own.repartition("unit_c", "unit_d").sortWithinPartitions("unit_c", "unit_d", F.desc("depth"), "conv_id")
        sent = dealt.select("conv_id", "depth", "parent_conv_id", "n_leaves", "saved_tokens") \
                    .mapInArrow(_forward(shard_convs, shard_depth, queue_rows), SENT)
        rounds.append(stored(sent, "sent"))
        got = rounds[-1].where("to_conv is not null").groupBy(F.col("to_conv").alias("conv_id"), (F.col("depth") - 1).alias("depth")) \
            .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        got = stored(got, "roots")
        if got.isEmpty():
            break
        touched = got.select(*units).distinct()
        own = kept.drop("n_leaves", "saved_tokens").join(touched, ["unit_c", "unit_d"], "left_semi") \
            .join(got, ["conv_id", "depth"], "left").fillna(0, ["n_leaves", "saved_tokens"])
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    return every.groupBy("conv_id", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


# --- ends ----------------------------------------------------------------------------------------

def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, id, conv_id) -> ids of one node as text, ``CHUNK`` at a time."""
    node, ids = None, []
    for b in batches:
        out = []
        for d, i, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if ids and ((d, i) != node or len(ids) >= CHUNK):
                out.append((*node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = (d, i)
            ids.append(c)
        if out:
            yield _chunk_rows(out)
    if ids:
        yield _chunk_rows([(*node, ids[0], ",".join(map(str, ids)))])


def _chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    d, i, first, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.binary()), pa.array(first, pa.int64()),
                                       pa.array(ids, pa.string())], ["depth", "id", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, None

    def done(rows: list) -> pa.RecordBatch:
        d, i, x = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.binary()), pa.array(x, pa.string())],
                                          ["depth", "id", "ends_sha256"])

    for b in batches:
        out = []
        for d, i, ids in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if (d, i) != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = (d, i), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield done(out)
    if node is not None:
        yield done([(*node, digest.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, id, ends_sha256) of the conversations (depth, id, conv_id) that end at each node."""
    keys = ["depth", "id", "conv_id"]
    chunks = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys) \
        .mapInArrow(_chunks, "depth long, id binary, first long, ids string")
    return chunks.repartition("depth", "id").sortWithinPartitions("depth", "id", "first").select("depth", "id", "ids") \
        .mapInArrow(_digests, "depth long, id binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, long_rows: int = LONG_ROWS, shard_convs: int = SHARD_CONVS,
                shard_depth: int = SHARD_DEPTH, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    pieces, convs = rebuilt(conversations, long_rows)
    passed = stored(members(pieces), "members")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("parent"),
                      "n_convs", F.lit(0).cast("long").alias("chars"))
    nodes = passed.groupBy("depth", "id").agg(F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"),
                                              F.count("*").alias("n_convs"), F.first("chars").alias("chars"))
    nodes = stored(nodes.unionByName(top), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = stored(nodes.join(above, ["depth", "parent"], "left"), "linked")
    children = linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")) \
        .agg(F.count("*").alias("n_children"))
    whole = stored(linked.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children"]), "whole")
    own = whole.select("conv_id", "depth", "parent_conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    ends = passed.where("last").select("depth", "id", "conv_id").unionByName(
        convs.where("total = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("id"), "conv_id"))
    found = whole.join(subtree_totals(own, shard_convs, shard_depth, queue_rows), ["conv_id", "depth"]) \
        .join(end_digests(ends), ["depth", "id"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id AS c, turn, sha256(length(r) || ':' || r || ':' || t) AS mark, length(t) AS chars
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
), own AS (
  SELECT c, list({'mark': mark, 'chars': chars} ORDER BY turn NULLS FIRST, mark) AS s,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
        lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)),
                                lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END)),
        4294967295::BIGINT) % 6 AS h
  FROM turns GROUP BY c
), rebuilt AS (
  SELECT a.c, list_concat(CASE WHEN b.c IS NULL THEN [] ELSE b.s[1:a.h] END, a.s[a.h + 1:]) AS s
  FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 100
), passed AS (
  SELECT c, d, CASE WHEN d = 0 THEN [] ELSE s[1:d] END AS p, d = len(s) AS ends
  FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, p, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE p[d].chars END AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM passed GROUP BY d, p
), linked AS (
  SELECT n.*, a.c AS parent_conv_id FROM nodes n
  LEFT JOIN nodes a ON a.d = n.d - 1 AND a.p = CASE WHEN n.d = 1 THEN [] ELSE n.p[1:n.d - 1] END
), counted AS (
  SELECT n.*, (SELECT count(*) FROM linked k WHERE k.parent_conv_id = n.c AND k.d = n.d + 1) AS n_children FROM linked n
), above AS (
  SELECT d AS top, CASE WHEN d = 0 THEN [] ELSE p[1:d] END AS p, n_children, saved
  FROM (SELECT p, n_children, saved, unnest(range(d + 1)) AS d FROM counted)
), totals AS (
  SELECT top, p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY top, p
)
SELECT n.c AS conv_id, n.d AS depth, n.parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM counted n JOIN totals t ON t.top = n.d AND t.p = n.p
"""
