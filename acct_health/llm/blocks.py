"""Which items occur more than once in the corpus, asked by blocks of texts and answered by shards.

Texts are dealt over blocks of bounded size, equal texts as one *class* with its count. Every block
sends each shard the items that fall into the shard's range; the shard adds up what all blocks sent
and answers each block with one bit per item sent. Nothing passes through the driver, nothing is
broadcast, and the rows between blocks and shards hold many items each.

``Sketch`` asks about cells of a count-min sketch: a shard merges the partial sketches of its range,
and an item is *estimated* repeated if its cell reaches two in every row of the sketch. That can
only overestimate. ``Exact`` asks about 128-bit fingerprints of the items themselves.

Blocks and shards both grow with the text, so questions of every block to every shard would grow with
its square. Beyond ``DIRECT_SHARDS`` shards, a block asks *ranges* of about the root of their number,
and relays (a range for a band of blocks) add up what they get and ask the range's shards. A block then
sends about the root of the number of shards, and a relay holds about as many items as a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acct_health.llm.common import mix

#: Bytes of text in a block and items in a shard, on average: what one task holds at a time.
BLOCK_BYTES = 4 << 20
SHARD_ITEMS = 3 << 20
#: Shards that every block asks by itself; more are asked through relays.
DIRECT_SHARDS = 64


@dataclass(frozen=True)
class Layout:
    """``ranges`` (None: as many as shards) and ``shards`` are powers of two, so a range is whole shards."""

    blocks: int
    shards: int
    cell_bits: int
    ranges: int | None = None

    @property
    def asked(self) -> int:
        """The number of ranges that a block asks."""
        return self.ranges or self.shards

    @property
    def bands(self) -> int:
        """The number of relays of a range, so that relays are as many as shards."""
        return self.shards // self.asked

    @classmethod
    def of(cls, docs: DataFrame, cells_per_item: int = 2) -> Layout:
        """Numbers of blocks, shards and sketch cells in proportion to the text (one aggregate job)."""
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        items = max(1, size // 6)  # about one word, so one window, for six bytes
        bits = max(16, int(items * cells_per_item - 1).bit_length())
        shards = min(1 << max(0, (items // SHARD_ITEMS).bit_length()), 1 << (bits - 8))
        ranges = 1 << (shards.bit_length() // 2) if shards > DIRECT_SHARDS else None
        return cls(max(1, -(-size // BLOCK_BYTES)), shards, bits, ranges)


def text_hash(text):
    """What tells texts apart: SHA-256 (null as empty)."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def text_classes(docs: DataFrame, layout: Layout) -> DataFrame:
    """(block, h, text, n): equal texts of one task as one row, later sightings as a count."""
    blocks = layout.blocks

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again: dict[bytes, int] = {}
        for b in batches:
            keys, new = b.column("h").to_pylist(), []
            for i, k in enumerate(keys):
                if k in again:
                    again[k] += 1
                else:
                    again[k] = 0
                    new.append(i)
            if new:
                rows = b.take(pa.array(new))
                yield _rows(rows.column("h"), rows.column("text"), np.ones(len(new), np.int64), blocks)
        more = [k for k, n in again.items() if n]
        if more:
            yield _rows(pa.array(more, pa.binary()), pa.nulls(len(more), pa.string()),
                        np.array([again[k] for k in more], np.int64), blocks)

    part = docs.select(text_hash(F.col("text")).alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    return part.mapInArrow(collapse, "block int, h binary, text string, n long")


def _rows(h: pa.Array, text: pa.Array, n: np.ndarray, blocks: int) -> pa.RecordBatch:
    block = [int.from_bytes(x[:8], "little") % blocks for x in h.to_pylist()]
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), h, text, pa.array(n)], ["block", "h", "text", "n"])


def block_texts(table: pa.Table) -> tuple[list[bytes], pa.Array, np.ndarray]:
    """Classes of a block in the order of their hash, whatever order the shuffle brought them in:
    (hashes, texts, counts)."""
    h = table.column("h").to_pylist()
    count: dict[bytes, int] = {}
    row: dict[bytes, int] = {}
    for i, (k, n, there) in enumerate(zip(h, table.column("n").to_pylist(), table.column("text").is_valid().to_pylist(),
                                          strict=True)):
        count[k] = count.get(k, 0) + n
        if there:
            row[k] = i
    order = sorted(count)
    texts = table.column("text").take(pa.array([row[k] for k in order], pa.int64()))
    return order, texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, \
        np.array([count[k] for k in order], np.int64)


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(pa.py_buffer(np.ascontiguousarray(x)), "zstd", asbytes=True)


def _unpack(blob: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _sum_by_key(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and whether their weights reach two."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, np.zeros(0, bool)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(np.minimum(weights, 2), at) >= 2


ASK = "key int, block int, n long, first binary, second binary, twice binary"
ANSWER = "block int, key int, n long, bits binary"


def _question(key: int, block: int, first: np.ndarray, second: np.ndarray | None, twice: np.ndarray) -> dict:
    return {"key": key, "block": block, "n": len(first), "first": _pack(first),
            "second": None if second is None else _pack(second), "twice": _pack(np.packbits(twice))}


def _table(rows: list[dict], kind: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in kind.split(", ")])
    return pa.Table.from_pylist(rows, schema)


def answers_by_key(table: pa.Table) -> dict[int, np.ndarray]:
    return {k: np.unpackbits(_unpack(bits, -(-n // 8), np.uint8), count=n).astype(bool)
            for k, n, bits in zip(table.column("key").to_pylist(), table.column("n").to_pylist(),
                                  table.column("bits").to_pylist(), strict=True)}


class Sketch:
    """A count-min sketch of ``rows`` rows, each of 2 ** cell_bits cells cut into shards by range."""

    def __init__(self, layout: Layout, rows: int = 2):
        self.layout, self.rows = layout, rows

    def _cells(self, items: np.ndarray, row: int) -> np.ndarray:
        own = items if row == 0 else mix(items + np.uint64(0x9E3779B97F4A7C15) * np.uint64(row))
        return own >> np.uint64(64 - self.layout.cell_bits)

    def _per(self, parts: int) -> int:
        return -(-(1 << self.layout.cell_bits) // parts)

    def _cut(self, cells: np.ndarray, parts: int, first: int = 0, n: int | None = None) -> list[int]:
        """Where each of ``n`` parts of the sketch from number ``first`` on begins in the sorted cells, and their end."""
        edges = (first + np.arange((parts if n is None else n) + 1, dtype=np.uint64)) * np.uint64(self._per(parts))
        return np.searchsorted(cells, edges).tolist()

    def _ask(self, row: int, block: int, cells: np.ndarray, twice: np.ndarray, parts: int, first: int, n: int) -> list[dict]:
        out, cut, per = [], self._cut(cells, parts, first, n), self._per(parts)
        for s in range(n):
            own = cells[cut[s]:cut[s + 1]]
            if len(own):
                gaps = np.diff(own, prepend=np.uint64((first + s) * per))
                kind = next(k for k in (np.uint16, np.uint32, np.uint64) if gaps.max() <= np.iinfo(k).max)
                out.append(_question(row * parts + first + s, block, gaps.astype(kind),
                                     np.array([np.dtype(kind).itemsize], np.uint8), twice[cut[s]:cut[s + 1]]))
        return out

    @staticmethod
    def _asked(r: dict) -> tuple[np.ndarray, np.ndarray]:
        """A question's cells, from the first of its range on, and which of them count twice."""
        kind = np.dtype(f"u{_unpack(r['second'], 1, np.uint8)[0]}")
        return (np.cumsum(_unpack(r["first"], r["n"], kind), dtype=np.int64),
                np.unpackbits(_unpack(r["twice"], -(-r["n"] // 8), np.uint8), count=r["n"]))

    def questions(self, block: int, items: np.ndarray, weights: np.ndarray) -> list[dict]:
        out = []
        for row in range(self.rows):
            cells, twice = _sum_by_key(self._cells(items, row), weights)
            out += self._ask(row, block, cells, twice, self.layout.asked, 0, self.layout.asked)
        return out

    def _relayed(self, key: int, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct cells of a relay's questions, which of them count twice, and each question's cells."""
        start = key % self.layout.asked * self._per(self.layout.asked)
        read = [self._asked(r) for r in rows]
        own = [(cells + start).astype(np.uint64) for cells, _ in read]
        cells, twice = _sum_by_key(np.concatenate(own), np.concatenate([t for _, t in read]).astype(np.int64) + 1)
        return cells, twice, own

    def relay(self, key: int, relay: int, rows: list[dict]) -> list[dict]:
        """A relay's questions to the shards of its range."""
        row, part = divmod(key, self.layout.asked)
        cells, twice, _ = self._relayed(key, rows)
        return self._ask(row, relay, cells, twice, self.layout.shards, part * self.layout.bands, self.layout.bands)

    def passed_back(self, key: int, rows: list[dict], answers: dict[int, np.ndarray]) -> list[np.ndarray]:
        """The answer to each question of a relay, from the shards' answers."""
        cells, _, own = self._relayed(key, rows)
        hit = np.concatenate([answers[k] for k in sorted(answers)])  # shards in order of their cells
        return [hit[np.searchsorted(cells, x)] for x in own]

    def merge(self) -> Callable[[pa.Table], pa.Table]:
        per = self._per(self.layout.shards)

        def shard(table: pa.Table) -> pa.Table:
            """Adds up the blocks' partial sketches of one range, counts kept up to two."""
            count = np.zeros(per, np.uint8)
            asked = table.to_pylist()
            for r in asked:
                cells, twice = self._asked(r)
                count[cells] = np.minimum(count[cells] + 1 + twice, 2)
            return _table([{"block": r["block"], "key": r["key"], "n": r["n"],
                            "bits": _pack(np.packbits(count[self._asked(r)[0]] >= 2))} for r in asked], ANSWER)

        return shard

    def repeated(self, items: np.ndarray, answers: dict[int, np.ndarray]) -> np.ndarray:
        """Items whose estimate is two or more."""
        out = np.ones(len(items), bool)
        parts = self.layout.asked
        for row in range(self.rows):
            own = self._cells(items, row)
            cells = np.unique(own)
            cut = self._cut(cells, parts)
            hit = np.zeros(len(cells), bool)
            for s in range(parts):
                if cut[s + 1] > cut[s]:
                    hit[cut[s]:cut[s + 1]] = answers[row * parts + s]
            out &= hit[np.searchsorted(cells, own)] if len(cells) else out
        return out


class Exact:
    """Exact grouping of items by a 128-bit fingerprint (two independent 64-bit hashes)."""

    def __init__(self, layout: Layout):
        self.layout = layout

    @staticmethod
    def _distinct(a: np.ndarray, b: np.ndarray, weights: np.ndarray):
        order = np.lexsort((b, a))
        a, b, weights = a[order], b[order], np.minimum(weights[order], 2)
        if not len(a):
            return a, b, np.zeros(0, np.int64), order, np.zeros(0, np.int64)
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        at = np.flatnonzero(new)
        return a[at], b[at], np.add.reduceat(weights, at), order, np.cumsum(new) - 1

    @staticmethod
    def _cut(a: np.ndarray, parts: int, first: int = 0, n: int | None = None) -> list[int]:
        """Where each of ``n`` parts of the hashes from number ``first`` on begins in the sorted ones, and their end."""
        n = parts if n is None else n
        edges = np.array([(first + s) * ((1 << 64) // parts) for s in range(n)], np.uint64)
        end = (first + n) * ((1 << 64) // parts)
        return np.searchsorted(a, edges).tolist() + [len(a) if end >= 1 << 64 else int(np.searchsorted(a, np.uint64(end)))]

    def _ask(self, block: int, a: np.ndarray, b: np.ndarray, twice: np.ndarray, parts: int, first: int, n: int) -> list[dict]:
        cut = self._cut(a, parts, first, n)
        return [_question(first + s, block, a[cut[s]:cut[s + 1]], b[cut[s]:cut[s + 1]], twice[cut[s]:cut[s + 1]])
                for s in range(n) if cut[s + 1] > cut[s]]

    @staticmethod
    def _asked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The items of all questions in a row, and how often they count."""
        twice = np.concatenate([np.unpackbits(_unpack(r["twice"], -(-r["n"] // 8), np.uint8), count=r["n"]) for r in rows])
        return (np.concatenate([_unpack(r["first"], r["n"], np.uint64) for r in rows]),
                np.concatenate([_unpack(r["second"], r["n"], np.uint64) for r in rows]), twice.astype(np.int64) + 1)

    def questions(self, block: int, a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> list[dict]:
        a, b, total, _, _ = self._distinct(a, b, weights)
        return self._ask(block, a, b, total >= 2, self.layout.asked, 0, self.layout.asked)

    def relay(self, key: int, relay: int, rows: list[dict]) -> list[dict]:
        """A relay's questions to the shards of its range."""
        a, b, total, _, _ = self._distinct(*self._asked(rows))
        return self._ask(relay, a, b, total >= 2, self.layout.shards, key * self.layout.bands, self.layout.bands)

    def passed_back(self, key: int, rows: list[dict], answers: dict[int, np.ndarray]) -> list[np.ndarray]:
        """The answer to each question of a relay, from the shards' answers."""
        a, b, weights = self._asked(rows)
        _, _, _, order, group = self._distinct(a, b, weights)
        hit = np.empty(len(a), bool)
        hit[order] = np.concatenate([answers[k] for k in sorted(answers)])[group]  # shards in order of their items
        return np.split(hit, np.cumsum([r["n"] for r in rows])[:-1])

    def merge(self) -> Callable[[pa.Table], pa.Table]:
        def shard(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            a, b, weights = self._asked(rows)
            _, _, total, order, group = self._distinct(a, b, weights)
            hit = np.empty(len(a), bool)
            hit[order] = (total >= 2)[group]
            out, i = [], 0
            for r in rows:
                out.append({"block": r["block"], "key": r["key"], "n": r["n"],
                            "bits": _pack(np.packbits(hit[i:i + r["n"]]))})
                i += r["n"]
            return _table(out, ANSWER)

        return shard

    def repeated(self, a: np.ndarray, b: np.ndarray, answers: dict[int, np.ndarray]) -> np.ndarray:
        parts = self.layout.asked
        da, _, _, order, group = self._distinct(a, b, np.ones(len(a), np.int64))
        cut = self._cut(da, parts)
        hit = np.zeros(len(da), bool)
        for s in range(parts):
            if cut[s + 1] > cut[s]:
                hit[cut[s]:cut[s + 1]] = answers[s]
        out = np.zeros(len(a), bool)
        out[order] = hit[group] if len(da) else False
        return out


def answered(asked: DataFrame, tool: Sketch | Exact) -> DataFrame:
    """The answers to blocks' questions. A block's row with a key under zero is no question: it comes back
    to the block as it is, under key -1."""
    bands = tool.layout.bands
    if bands == 1:
        return asked.groupBy("key").applyInArrow(_keeping_own(tool.merge()), ANSWER)
    at = F.col("key").cast("long") * bands + F.pmod(F.col("block"), F.lit(bands))
    asked = asked.withColumn("relay", F.when(F.col("key") >= 0, at).otherwise(F.col("key")))

    def up(key: tuple, table: pa.Table) -> pa.Table:
        relay = key[0].as_py()
        return _table(tool.relay(relay // bands, relay, _in_order(table)) if relay >= 0 else [], ASK)

    def down(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        relay = key[0].as_py()
        if relay < 0:
            return _own(table)
        rows = _in_order(table)
        bits = tool.passed_back(relay // bands, rows, answers_by_key(got))
        return _table([{"block": r["block"], "key": r["key"], "n": r["n"], "bits": _pack(np.packbits(x))}
                       for r, x in zip(rows, bits, strict=True)], ANSWER)

    relayed = asked.groupBy("relay").applyInArrow(up, ASK).groupBy("key").applyInArrow(tool.merge(), ANSWER)
    return asked.groupBy("relay").cogroup(relayed.groupBy(F.col("block").cast("long"))).applyInArrow(down, ANSWER)


def _in_order(table: pa.Table) -> list[dict]:
    return table.sort_by("block").to_pylist()


def _own(table: pa.Table) -> pa.Table:
    return pa.table({"block": table.column("block"), "key": pa.array([-1] * len(table), pa.int32()),
                     "n": table.column("n"), "bits": table.column("first")})


def _keeping_own(merge):
    def shard(table: pa.Table) -> pa.Table:
        return merge(table) if table.column("key")[0].as_py() >= 0 else _own(table)

    return shard


def ask(classes: DataFrame, question: Callable[[int, pa.Table], list[dict]], tool: Sketch | Exact) -> DataFrame:
    """Every block's question to the shards, and the shards' answers by block."""

    def by_block(key: tuple, table: pa.Table) -> pa.Table:
        return _table(question(key[0].as_py(), table), ASK)

    return answered(classes.groupBy("block").applyInArrow(by_block, ASK), tool)


def ask_again(classes: DataFrame, answers: DataFrame, question, tool: Sketch | Exact) -> DataFrame:
    """As ``ask``, for a question that needs the answers to an earlier one."""

    def by_block(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        return _table(question(key[0].as_py(), table, answers_by_key(got)), ASK)

    return answered(classes.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(by_block, ASK), tool)
