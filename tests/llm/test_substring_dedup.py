"""Substring dedup against brute force over windows of words."""

import hashlib
import random
from collections import Counter

from acct_health.llm import blocks
from acct_health.llm.blocks import Exact, Layout, Sketch
from acct_health.llm.substring_dedup import repeated_words, substring_dedup
from acct_health.llm.blocks import text_hash

import numpy as np
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def _words(text):
    for b in BLANKS:
        text = (text or "").replace(b, " ") if text else ""
    return [w for w in text.split(" ") if w]


def _expected(rows, width):
    seen = Counter(tuple(w[i:i + width]) for w in (_words(t) for _, t in rows) for i in range(len(w) - width + 1))
    out = []
    for d, t in rows:
        w = _words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d if d is not None else -1, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def _rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)] + ["é,", "日本", "x y"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(n))
    shared = [text(n) for n in (4, 5, 9, 30)]
    rows = [text(rng.randrange(0, 60)) + rng.choice(shared) + text(rng.randrange(0, 20)) for _ in range(60)]
    rows += [rows[0]] * 5 + ["a b " * 30, "a b a b a b", None, "", " \n ", "one two three"] + ["z" * 5000 + " " + shared[3]]
    return [(i if i != 7 else None, t) for i, t in enumerate(rows)]


def _got(spark, rows, width):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeated_words(docs, width)
    joined = docs.select("doc_id", text_hash(F.col("text")).alias("__h")).join(found, "__h")
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in joined.collect())


def test_brute_force(spark):
    rows = _rows()
    assert _got(spark, rows, 5) == _expected(rows, 5)
    assert _got(spark, rows, 1) == _expected(rows, 1)


def test_texts_are_cut(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, "own one " + passage + " end", "en", 7, 1), (2, passage + "\nother", "en", 8, 2), (3, "short text", None, 10, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, n_words long")
    got = {r.doc_id: r for r in substring_dedup(docs).collect()}
    assert substring_dedup(docs).columns == docs.columns
    assert (got[1].text, got[1].n_chars, got[2].text, got[3].text, got[3].n_chars, got[3].n_words) == ("own one end", 11, "other", "short text", 10, 3)
    assert substring_dedup(docs.where("false")).count() == 0


def test_a_sketch_never_misses():
    rng = np.random.default_rng(4)
    items = [rng.integers(0, 1 << 63, 3000, np.uint64) for _ in range(4)]
    items[1][:200] = items[0][:200]
    items[3][:50] = items[2][100:150]
    layout = Layout(4, 4, 14)
    for tool in (Sketch(layout), Exact(layout)):
        pair = (lambda x: (x, x + np.uint64(5))) if isinstance(tool, Exact) else (lambda x: (x,))
        asked = [q for b, x in enumerate(items) for q in tool.questions(b, *pair(x), np.ones(len(x), np.int64))]
        merge, answers = tool.merge(), {}
        from acct_health.llm.blocks import ASK, _table, answers_by_key
        for key in {q["key"] for q in asked}:
            for r in merge(_table([q for q in asked if q["key"] == key], ASK)).to_pylist():
                answers.setdefault(r["block"], []).append(r)
        import pyarrow as pa
        hits = [tool.repeated(*pair(x), answers_by_key(pa.Table.from_pylist(answers[b]))) for b, x in enumerate(items)]
        assert hits[0][:200].all() and hits[1][:200].all() and hits[2][100:150].all() and hits[3][:50].all()
        if isinstance(tool, Exact):
            assert sum(h.sum() for h in hits) == 500
        else:
            assert sum(h.sum() for h in hits) < 9000  # a narrow sketch says yes too often, but not always


def test_relays_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(blocks, "SHARD_ITEMS", 100)
    monkeypatch.setattr(blocks, "DIRECT_SHARDS", 2)
    rows = _rows()
    layout = Layout.of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert layout.shards >= 32 and layout.asked < layout.shards == layout.asked * layout.bands and layout.blocks > 8
    assert _got(spark, rows, 5) == _expected(rows, 5)
    assert substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").where("false")).count() == 0


def test_messages_of_a_block_grow_with_the_root_of_the_shards():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 63, 40_000, np.uint64) * np.uint64(2)
    sent = {}
    for shards in (256, 4096):
        layout = Layout(100, shards, 40, 1 << (shards.bit_length() // 2))
        for tool in (Sketch(layout, rows=1), Exact(layout)):
            pair = (items, items) if isinstance(tool, Exact) else (items,)
            asked = tool.questions(0, *pair, np.ones(len(items), np.int64))
            relayed = tool.relay(asked[3]["key"], 7, [asked[3]])
            assert len(relayed) <= layout.bands and sum(r["n"] for r in relayed) == asked[3]["n"]
            sent[type(tool), shards] = len(asked)
    assert all(sent[t, 4096] <= 4 * sent[t, 256] == 64 for t in (Sketch, Exact))


def test_few_cells_in_a_wide_range():
    """Gaps of over 32 bits between a question's cells."""
    tool = Sketch(Layout(1, 16, 60, 4), rows=1)
    items = np.array([5 << 4, 3 << 61, (3 << 61) + (9 << 4)], np.uint64)
    asked = tool.questions(0, items, np.array([1, 2, 1]))
    for q in asked:
        up = tool.relay(q["key"], 0, [q])
        answers = {r["key"]: np.unpackbits(blocks._unpack(r["twice"], -(-r["n"] // 8), np.uint8), count=r["n"]).astype(bool) for r in up}
        back = tool.passed_back(q["key"], [q], answers)[0]
        assert back.tolist() == ([False] if q["n"] == 1 else [True, False])
    assert sorted(q["n"] for q in asked) == [1, 2]
