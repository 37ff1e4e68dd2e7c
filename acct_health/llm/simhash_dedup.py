"""SimHash near-dedup: fingerprints within a Hamming radius, found in BK-trees of shards.

* Fingerprints: words of the whole text (A-Z lower-cased), shingles of ``width`` words with repeats, each
  shingle's XXH64 (seed 42); a bit is set if it is in over half of the hashes. A bounded run of
  shingles at a time, so a very long text needs no memory of its size in hashes.
* Equal fingerprints are one entry before anything is searched, however many texts have it.
* Shards: the 64 bits are cut into ``radius`` + 1 bands; fingerprints within the radius agree in one band
  at least. An entry is filed under each of its bands' values; a shard holds the values of a hash range.
  A value with over ``MAX_TREE`` entries is filed again, under bands of its other bits, until it is
  not; each step leaves two thirds of the bits, so five steps leave fewer values than ``MAX_TREE``.
* Trees: a shard's entries form one BK-tree per value. A node's children are keyed by their integer Hamming
  distance to it, and the tree is stored as one row of arrays (at most some 20 bytes for each of
  ``MAX_TREE`` + ``SHARD_ENTRIES`` entries). Queries, in blocks of ``QUERY_BLOCK`` entries, meet the trees of
  their shard by a join. Spark broadcasts the trees where their stored size is under
  spark.sql.autoBroadcastJoinThreshold, and else sends each tree to its blocks. A query at distance d
  of a node follows only the edges from d - radius to d + radius.
* A pair that agrees in several bands is reported for the first of them. An entry has at most 2080 others
  within two bits, so links grow in proportion to the entries. Components of the links give the result.

Defined results: a null or wordless text has the fingerprint zero and is linked like any other. Repeated
rows and ids each give a row; a class's id is the least ``doc_id`` (null ids last; null if all are). An
empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acct_health.llm.common import read_table, stored
from acct_health.llm.components import components

SEED = 42
#: Entries of one value and, on average, of one shard; entries in a block of queries.
MAX_TREE = 8192
SHARD_ENTRIES = 4096
QUERY_BLOCK = 4096
#: Shingles hashed at once, and (query, node) pairs looked at in one step.
RUN = 1 << 16
FRONTIER = 1 << 18

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits (lowest first)."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 512:
        return np.unpackbits(columns, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BITS for i in range(8)])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[min(width, len(words)) - 1:].tolist()
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, RUN):
        run = [digest(line[a:b], SEED) for a, b in zip(starts[i:i + RUN], ends[i:i + RUN], strict=True)]
        total += _bit_counts(np.array(run, "<u8"))
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row, as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


# --- bands ---------------------------------------------------------------------------------------

def bands(taken: tuple[int, ...], n: int) -> list[int]:
    """Masks of ``n`` bands of the bits that ``taken``, the masks of a path, leaves."""
    left = [b for b in range(64) if not any(m >> b & 1 for m in taken)]
    cut = [len(left) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in left[cut[i]:cut[i + 1]]) for i in range(n)]


def path_masks(path: str, n: int) -> list[tuple[int, list[int]]]:
    """For each step of a path, its band's mask and the masks of the bands before it."""
    taken, out = (), []
    for digit in path:
        masks = bands(taken, n)
        out.append((masks[int(digit)], masks[:int(digit)]))
        taken += (masks[int(digit)],)
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _filed(entries: DataFrame, paths: list[str], n: int) -> DataFrame:
    """Entries (path, fp) filed under the bands that their path leaves: (path, value, fp)."""
    masks = []
    for p in paths:
        taken = tuple(m for m, _ in path_masks(p, n))
        masks += [F.lit(p), F.array(*[F.lit(_signed(sum(taken) | m)) for m in bands(taken, n)])]
    own = F.element_at(F.create_map(*masks), F.col("path"))
    return entries.select("path", "fp", F.posexplode(own).alias("band", "mask")).select(
        F.concat("path", F.col("band").cast("string")).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def file_entries(entries: DataFrame, radius: int, max_tree: int = MAX_TREE) -> DataFrame:
    """(path, value, fp): distinct fingerprints filed so that no (path, value) has over ``max_tree``."""
    n, done = radius + 1, None
    now = stored(_filed(entries.select(F.lit("").alias("path"), "fp"), [""], n), "filed")
    while True:
        full = stored(now.groupBy("path", "value").count().where(F.col("count") > max_tree).select("path", "value"), "full")
        paths = [r.path for r in full.select("path").distinct().collect()]  # bands, not entries: at most n to the power of steps
        small = now.join(full, ["path", "value"], "left_anti") if paths else now
        done = small if done is None else done.unionByName(small)
        if not paths:
            return done
        now = stored(_filed(now.join(full, ["path", "value"], "left_semi"), paths, n), "filed")


# --- trees ---------------------------------------------------------------------------------------

def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees of one shard, one per group. Nodes are entries; ``edge`` keys (parent, distance) are sorted,
    ``child`` has the node that each leads to."""

    def __init__(self, fps: np.ndarray, edges: np.ndarray, children: np.ndarray):
        self.fps, self.edge, self.child = fps, edges, children

    @classmethod
    def grow(cls, fps: np.ndarray, roots: np.ndarray) -> Forest:
        """``roots`` has each entry's root (its own place, if it is one). All entries descend together: of those that
        reach a free edge, the first becomes the child, as if entries were put in one by one."""
        at = np.flatnonzero(roots != np.arange(len(fps)))
        node = roots[at]
        edges, children = [], []
        while len(at):
            key = node * 65 + distance(fps[at], fps[node])
            own, first, group = np.unique(key, return_index=True, return_inverse=True)
            edges.append(own)
            children.append(at[first])
            node = at[first][group]
            rest = node != at
            at, node = at[rest], node[rest]
        if not edges:
            return cls(fps, np.zeros(0, np.int64), np.zeros(0, np.int64))
        edges, children = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edges)
        return cls(fps, edges[order], children[order])

    def near(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) places within the radius, from each query's root down the edges that can hold one."""
        stack = [(np.arange(len(queries)), roots)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                stack += [(q[FRONTIER:], node[FRONTIER:]), (q[:FRONTIER], node[:FRONTIER])]
                continue
            d = distance(queries[q], self.fps[node])
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            if n.any():
                start = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n)
                stack.append((np.repeat(q, n), self.child[start + np.arange(n.sum())]))


def _groups(paths: list[str], values: np.ndarray) -> tuple[np.ndarray, dict[str, int]]:
    """Entries in order of (path, value), the paths numbered."""
    known = {p: i for i, p in enumerate(sorted(set(paths)))}
    number = np.array([known[p] for p in paths], np.int64)
    return np.lexsort((values, number)), known


TREE = "shard long, paths array<string>, path_start array<long>, fps binary, roots binary, edges binary, children binary"
BLOCK = "shard long, paths array<string>, path_start array<long>, queries binary"


def _build(key: tuple, table: pa.Table) -> pa.Table:
    fps = table.column("fp").to_numpy().view(np.uint64)
    values = table.column("value").to_numpy()
    order, paths = _groups(table.column("path").to_pylist(), values)
    number = np.array([paths[p] for p in table.column("path").to_pylist()], np.int64)[order]
    fps, values = fps[order], values[order]
    new = np.concatenate(([True], (values[1:] != values[:-1]) | (number[1:] != number[:-1])))
    roots = np.flatnonzero(new)[np.cumsum(new) - 1]
    forest = Forest.grow(fps, roots)
    starts = np.searchsorted(number, np.arange(len(paths) + 1)).tolist()
    return pa.table({"shard": [key[0].as_py()], "paths": [sorted(paths)], "path_start": [starts], "fps": [fps.tobytes()],
                     "roots": [np.unique(roots).astype(np.int64).tobytes()], "edges": [forest.edge.tobytes()],
                     "children": [forest.child.astype(np.int64).tobytes()]})


def _search(radius: int):
    n = radius + 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fps = np.frombuffer(r["fps"], np.uint64)
                roots = np.frombuffer(r["roots"], np.int64)
                forest = Forest(fps, np.frombuffer(r["edges"], np.int64), np.frombuffer(r["children"], np.int64))
                for path, queries in zip(r["q_paths"], r["q_fps"], strict=True):
                    queries = np.array(queries, np.int64).view(np.uint64)
                    steps = path_masks(path, n)
                    whole = np.uint64(sum(m for m, _ in steps))
                    i = r["paths"].index(path)
                    own = roots[np.searchsorted(roots, r["path_start"][i]):np.searchsorted(roots, r["path_start"][i + 1])]
                    values = fps[own] & whole  # in the order of the signed values they were sorted by
                    by = np.argsort(values)
                    root = own[by][np.searchsorted(values[by], queries & whole)]
                    for q, node in forest.near(queries, root, radius):
                        a, c = queries[q], fps[node]
                        keep = a < c
                        for _, earlier in steps:
                            for m in earlier:
                                keep &= (a ^ c) & np.uint64(m) != 0
                        if keep.any():
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(a[keep].view(np.int64)), pa.array(c[keep].view(np.int64))], ["u", "v"])

    return search


def links(entries: DataFrame, radius: int = 2, max_tree: int = MAX_TREE, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(u, v): every pair of distinct fingerprints (column fp) that differ in 1 to ``radius`` bits, once."""
    filed = file_entries(entries, radius, max_tree)
    shards = max(1, -(-filed.count() // shard_entries))
    filed = stored(filed.withColumn("shard", F.pmod(F.xxhash64("path", "value"), F.lit(shards))), "entries")
    trees = stored(filed.groupBy("shard").applyInArrow(_build, TREE), "trees")
    block = F.pmod(F.xxhash64("fp"), F.lit(-(-(max_tree + shard_entries) // QUERY_BLOCK)))
    by_path = filed.groupBy("shard", block.alias("block"), "path").agg(F.collect_list("fp").alias("own"))
    blocks = by_path.groupBy("shard", "block").agg(F.collect_list(F.struct("path", "own")).alias("q")) \
        .select(F.col("shard").alias("q_shard"), F.col("q.path").alias("q_paths"), F.col("q.own").alias("q_fps"))
    met = blocks.join(trees, blocks["q_shard"] == trees["shard"]).drop("q_shard", "shard")
    return met.mapInArrow(_search(radius), "u long, v long")


def simhash_classes(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    own = stored(fingerprints(docs, width), "fingerprints")
    least = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(least.select("fp"), radius))
    named = least.join(found, least["fp"] == found["u"], "left").select("fp", F.coalesce("v", "fp").alias("head"), "least")
    heads = named.groupBy("head").agg(F.min("least").alias("component_id"))
    classes = named.join(heads, "head").select("fp", "component_id")
    return own.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the least id of those reachable by links of at most two bits."""
    return simhash_classes(read_table(spark, sf_dir, "documents"))
