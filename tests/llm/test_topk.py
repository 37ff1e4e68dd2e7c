"""Top-k search against brute force: ties, repeated vectors, odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acct_health.llm import topk
from acct_health.llm.topk import norm_sorted_topk


def _brute(rows, k):
    ints = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in [r for r in ints if r[0] % 20 == 0]:
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def _got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def _rows():
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.2, 1, 5]) * np.array([4, 2, 1, 1, .5, .1, .1, .1])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[20][1]) for i in range(300, 400)]  # ties
    return rows + [(400, None), (420, [None] * 8), (440, [float("nan")] * 8), (460, [float("inf")] + [0.0] * 7), (480, []), (None, [1.0] * 8),
                   (500, [0.0] * 8), (501, [1.0, 2.0]), (520, [0.5])]


def _search(spark, rows, k=20, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 as block", "2 as v", "3 as norm2")
    return norm_sorted_topk(frame, F.col("vec_id") % 20 == 0, k=k, **options)


def test_brute_force(spark):
    rows = _rows()
    assert _got(_search(spark, rows)) == _brute(rows, 20)


def test_many_blocks(spark):
    rows = _rows()
    assert _got(_search(spark, rows, k=5, block_rows=40)) == _brute(rows, 5)


def test_repeated_rows(spark):
    rows = _rows()[:120]
    rows += [rows[40], rows[40], rows[7], rows[60], (60, rows[3][1])]
    assert _got(_search(spark, rows, k=20)) == _brute(rows, 20)
    assert _got(_search(spark, rows, k=3, block_rows=30)) == _brute(rows, 3)


def test_bounds_reach_past_the_longest_vectors(spark):
    rows = _rows()
    assert _got(_search(spark, rows, k=4, first_rows=32)) == _brute(rows, 4)


def test_ties_beyond_the_bound_send_nothing():
    same = pa.array([[3, 4]] * 2000, pa.list_(pa.int64()))
    queries = pa.table({"q": [0, 1], "query_id": [20, 40], "v": same[:2], "bound": [25.0, 25.0], "bound_id": [30, 5]})
    block = pa.table({"vec_id": range(10, 2010), "v": same})
    got = topk._score(queries, block, 2, 5, np.eye(2), 0).to_pylist()
    assert [(h["q"], h["vec_id"]) for h in got] == [(0, i) for i in range(10, 15)]


def test_few_and_none(spark):
    rows = _rows()[:21]
    assert _got(_search(spark, rows, k=30)) == _brute(rows, 30)
    assert _search(spark, []).count() == 0
    assert _search(spark, [(20, [1.0])]).count() == 0


def test_tiles_that_bounds_leave_whole_are_one_matrix_product(monkeypatch):
    """Vectors without a strong direction: bounds drop few pairs, so none is scored by itself."""
    rng = np.random.default_rng(5)
    v = rng.integers(-9, 10, (3000, 32)).astype(float)
    ids, q = np.arange(3000), v[:200]
    want = []
    for i in range(200):
        s = v @ q[i]
        s[i] = -np.inf
        want += [(i, int(j), int(s[j])) for j in np.lexsort((ids, -s))[:20]]
    table = lambda m: pa.array(m.astype(int).tolist(), pa.list_(pa.int64()))
    queries = pa.table({"q": ids[:200], "query_id": ids[:200], "v": table(q), "bound": np.full(200, -np.inf), "bound_id": np.full(200, topk._NO_ID)})
    monkeypatch.setattr(np, "einsum", lambda *_: pytest.fail("scored pair by pair"))
    got = topk._score(queries, pa.table({"vec_id": ids, "v": table(v)}), 32, 20, np.eye(32), 512).to_pylist()
    assert [(h["q"], h["vec_id"], h["score"]) for h in got] == want


def test_pairs_and_tiles_find_the_same(monkeypatch):
    rows = _rows()
    for dense in (0, 1 << 40):  # never, always
        monkeypatch.setattr(topk, "DENSE", dense)
        block = pa.table({"vec_id": [i for i, v in rows[:300]], "v": pa.array([[math.floor(64 * x) for x in v] for _, v in rows[:300]], pa.list_(pa.int64()))})
        ask = block.take([i for i in range(300) if i % 20 == 0])
        queries = pa.table({"q": ask["vec_id"], "query_id": ask["vec_id"], "v": ask["v"], "bound": np.full(len(ask), -np.inf), "bound_id": np.full(len(ask), topk._NO_ID)})
        got = topk._score(queries, block, 8, 20, np.eye(8), 64).to_pylist()
        assert [(h["query_id"], h["vec_id"], h["score"]) for h in got] == [(q, i, s) for q, _, i, s in _brute(rows[:300], 20)]
