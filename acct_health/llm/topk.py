"""Exact top-k search by inner product over vectors in descending length, with rotated partial sums.

Components become integers floor(scale * x), so scores are exact. The vectors are sorted by length and
cut into blocks of ``BLOCK_ROWS``; a rotation from the singular vectors of all vectors puts most of
their length into the first coordinates.

1. Every group of queries is scored against the ``FIRST_ROWS`` longest vectors of the first block: the
   k-th score, with its id, is a first lower bound for each query.
2. The first block's other vectors, and every block whose longest vector can still reach the bound of a
   query group, are met by bounds: the sum over the first ``HEAD`` rotated coordinates plus the product of
   the two remainders' lengths (Cauchy-Schwarz) bounds each score from above. Pairs below the query's
   bound are dropped, the rest are scored exactly; of scores equal to it only smaller ids go on.
3. Blocks are searched in rounds, each of ``GROWTH`` times as many blocks as all before it, and every
   round starts from the bounds of the best k so far (by score, then the smaller id). So a round finds a
   few times k new pairs a query, however many blocks it has, and rounds grow with the logarithm of them.

Bounds carry a margin for rounding, so nothing that could tie is dropped. A query group or a block is
bounded; a pair of them is one row of work, so no task grows with the input and nothing is broadcast.

Defined results: a null vector, an empty one, or one with null or non-finite components takes no part;
vectors of several lengths are compared as if zeros followed the shorter one; rows with equal ids count
each by itself, as queries (each repeated row gets its own ``k`` places) and as candidates, except that a
query is not compared with rows of its own id; a null id takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acct_health.llm.common import read_table, stored

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
FIRST_ROWS = 512
GROWTH = 7
HEAD = 16
DENSE = 32


def integer_vectors(vectors: DataFrame, scale: int, vector: str = "embedding") -> DataFrame:
    """(vec_id, v, norm2): rows that take part, as integers with their squared length."""
    whole = F.col(vector).cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("w")).where(
        F.col("vec_id").isNotNull() & F.col("w").isNotNull() & (F.size("w") > 0)).where(
        F.forall("w", lambda x: x.isNotNull() & ~F.isnan(x) & ~x.isin(float("inf"), float("-inf"))))
    v = v.select("vec_id", F.transform("w", lambda x: F.floor(x * F.lit(scale))).alias("v"))
    return v.withColumn("norm2", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of integers as float64, padded with zeros; exact while scores stay below 2 ** 53."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim))
    size = np.diff(np.asarray(column.offsets))
    row = np.repeat(np.arange(len(column)), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at] = np.asarray(column.flatten())
    return out


def rotation(ints: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, strongest first: partial Gram matrices are added up in Spark
    (dim x dim numbers, however many rows there are)."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column("v"), dim)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = ints.select("v").mapInArrow(gram, "i long, row array<double>")
    summed = parts.groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(dim)]).orderBy("i").collect()
    g = np.array([[r[f"c{j}"] for j in range(dim)] for r in summed]) if summed else np.zeros((dim, dim))
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    return np.ascontiguousarray(vectors[:, np.argsort(-values)])


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ordered by query, score from the largest, id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    if not len(q):
        return order
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


_HITS = "q long, query_id long, vec_id long, score long"
_NO_ID = np.iinfo(np.int64).max


def _hits(row: np.ndarray, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"q": pa.array(row, pa.int64()), "query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()),
                     "score": pa.array(np.asarray(score, np.int64), pa.int64())})


def _score(queries: pa.Table, block: pa.Table, dim: int, k: int, turn: np.ndarray, first: int) -> pa.Table:
    """Each query's k best of the block, among pairs that can pass the query's bound. In the first block the
    bound comes from its ``first`` longest vectors (0: any other block)."""
    q, x = _matrix(queries.column("v"), dim), _matrix(block.column("v"), dim)
    qrow, qid, xid = (t.column(c).to_numpy() for t, c in ((queries, "q"), (queries, "query_id"), (block, "vec_id")))
    bound, bound_id = queries.column("bound").to_numpy().copy(), queries.column("bound_id").to_numpy().copy()
    qn = np.sqrt((q * q).sum(axis=1))
    xn = np.sqrt((x * x).sum(axis=1))
    order = np.lexsort((xid, -xn))
    x, xid, xn = x[order], xid[order], xn[order]
    head = min(HEAD, dim)
    qh, xh = q @ turn[:, :head], x @ turn[:, :head]
    qr = np.sqrt(np.maximum(qn * qn - (qh * qh).sum(axis=1), 0)) + 1e-6 * (1 + qn)
    xr = np.sqrt(np.maximum(xn * xn - (xh * xh).sum(axis=1), 0)) + 1e-6 * (1 + xn)
    start = min(len(xn), max(first, k)) if first else 0
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), 128):
        rows = slice(a, a + 128)
        parts = []  # (query, vector, score) of what was found so far
        if start:  # nothing to compare with yet: all scores, down to each query's k-th
            scores = q[rows] @ x[:start].T
            scores[qid[rows, None] == xid[None, :start]] = -np.inf
            low = np.partition(scores, -k, axis=1)[:, -k] if start > k else np.full(len(scores), -np.inf)
            i, j = np.nonzero((scores >= low[:, None]) & (scores > -np.inf))
            best = _best(i, xid[j], scores[i, j], k)
            i, j = i[best], j[best]
            parts.append((a + i, j, scores[i, j]))
            last = np.flatnonzero(np.append(i[1:] != i[:-1], True)) if len(i) else i
            last = last[np.bincount(i, minlength=len(scores))[i[last]] == k]
            bound[a + i[last]], bound_id[a + i[last]] = scores[i[last], j[last]], xid[j[last]]
        # descending lengths: a query needs only the vectors before the first that is too short
        reach = int(np.searchsorted(-xn, (-(bound[rows] - 1e-6 * (1 + abs(bound[rows]))) / np.maximum(qn[rows], 1e-300)).max(), side="right"))
        reach = len(xn) if (bound[rows] <= 0).any() else reach
        if reach > start:
            upper = qh[rows] @ xh[start:reach].T + qr[rows, None] * xr[None, start:reach]
            margin = 1e-9 * (1 + qn[rows, None] * xn[None, start:reach])
            can = upper + margin >= bound[rows, None]
            dense = DENSE * np.count_nonzero(can) > can.size
            if dense:  # bounds leave many pairs: all scores at once cost less than theirs one by one
                scores = q[rows] @ x[start:reach].T
                can &= scores >= bound[rows, None]
            i, j = np.nonzero(can)
            exact = scores[i, j] if dense else np.empty(len(i))
            i, j = i + a, j + start
            own = qid[i] != xid[j]
            i, j, exact = i[own], j[own], exact[own]
            for c in range(0, 0 if dense else len(i), 1 << 16):
                exact[c:c + (1 << 16)] = np.einsum("ij,ij->i", q[i[c:c + (1 << 16)]], x[j[c:c + (1 << 16)]])
            keep = (exact > bound[i]) | (exact == bound[i]) & (xid[j] < bound_id[i])
            parts.append((i[keep], j[keep], exact[keep]))
        if not parts:
            continue
        i, j, exact = (np.concatenate(c) for c in zip(*parts, strict=True))
        best = _best(i, xid[j], exact, k)
        i, j = i[best], j[best]
        found.append((qrow[i], qid[i], xid[j], exact[best]))
    if not found:
        return _hits(*[np.zeros(0)] * 4)
    return _hits(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def norm_sorted_topk(vectors: DataFrame, queries, k: int = 20, scale: int = 64, block_rows: int = BLOCK_ROWS,
                     first_rows: int = FIRST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products. ``queries`` is a
    condition on ``vec_id``."""
    ints = stored(integer_vectors(vectors, scale), "ints")
    size = ints.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    spark, dim = vectors.sparkSession, size.dim or 1
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not size.n:
        return empty
    turn = rotation(ints, dim)
    # blocks in descending length; their borders come from a range partitioning by length
    blocks = max(1, -(-size.n // block_rows))
    numbered = ints.withColumn("row", F.monotonically_increasing_id())
    sorted_ = stored(numbered.repartitionByRange(blocks, F.col("norm2").desc(), "vec_id", "row").withColumn(
        "block", F.spark_partition_id()), "sorted")
    spans = stored(sorted_.groupBy("block").agg(F.max("norm2").alias("longest")), "spans")
    ends = spans.agg(F.min("block").alias("first"), F.max("block").alias("last")).first()
    asked = sorted_.where(queries).select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), "v", F.sqrt("norm2").alias("qn"))
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    asked = stored(asked.withColumn("g", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int")), "queries")

    def search(q: DataFrame, x: DataFrame, first: int) -> DataFrame:
        def task(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            return _score(left, right, dim, k, turn, first)

        return q.groupBy("g", "block").cogroup(x.groupBy("g", "block")).applyInArrow(task, _HITS)

    no_bound = F.lit(float("-inf")), F.lit(int(_NO_ID))
    first = sorted_.where(F.col("block") == ends.first).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    start = asked.withColumn("bound", no_bound[0]).withColumn("bound_id", no_bound[1]).withColumn("block", F.lit(ends.first))
    seen = stored(_top(search(start, first.select("g", "block", "vec_id", "v"), first_rows), k), "seen")
    start, stop = ends.first + 1, ends.first + 1 + GROWTH
    while start <= ends.last:
        bounds = seen.where(F.col("rank") == k).select("q", F.col("score").cast("double").alias("b"), F.col("vec_id").alias("b_id"))
        bounded = asked.join(bounds, "q", "left").withColumn("bound", F.coalesce("b", no_bound[0])).withColumn("bound_id", F.coalesce("b_id", no_bound[1]))
        # which query groups a block can still serve: by its longest vector and the group's easiest query
        need = bounded.groupBy("g").agg(F.min(F.when(F.col("qn") > 0, F.col("bound") / F.col("qn")).otherwise(
            F.when(F.col("bound") <= 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))).alias("need"))
        pairs = need.withColumn("block", F.explode(F.sequence(F.lit(start), F.lit(min(stop - 1, ends.last))))).join(spans, "block").where(
            F.sqrt("longest") * (1 + 1e-9) >= F.col("need") - 1e-6).select("g", "block")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():  # no later block is longer, and no bound can fall
            break
        q = bounded.select("g", "q", "query_id", "v", "bound", "bound_id").join(pairs, "g")
        x = sorted_.join(pairs, "block").select("g", "block", "vec_id", "v")
        seen = stored(_top(seen.drop("rank").unionByName(search(q, x, 0)), k), "seen")
        start, stop = stop, stop + (stop - ends.first) * GROWTH
    return seen.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_sorted_topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""
