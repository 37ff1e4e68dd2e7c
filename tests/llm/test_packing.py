"""Packing: ids against the tokenizer, pieces and places against the rules, fill against a bound."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from acct_health.llm.packing import WordTokenizer, best_fit_packing, pieces, plan_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, " ", "Hello, World.", "don't we'll it's 's'x", "ÀÉÎ ß Straße ñandú.", "a<|endoftext|>b <|startoftext|>", "日本語 テキスト 🙂", "x" * 500,
         "123 4.5 #!$ a_b", "café café", "İstanbul ΣΑΣ", "tab\tnew\nline\x0bv\x0cf\rr", "nb sp em", "The the THE the, the. the,", "1." * 50]


def test_ids_are_the_tokenizer_s():
    full, own = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    ids, ends = own.batch(pa.array([t or "" for t in TEXTS]))
    for text, got in zip(TEXTS, np.split(ids, ends[:-1]), strict=True):
        assert got.tolist() == full.encode(text or "", add_special_tokens=False).ids + [0], text


def test_pieces(spark):
    texts = ["word " * 70, "one, two.", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length")
    got = {}
    for r in pieces(docs, PATH, 32).collect():
        got.setdefault(r.doc_id, []).append(r)
    full = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        ids = np.array(full.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        rows = sorted(got[i], key=lambda r: r.piece)
        assert [r.start for r in rows] == list(range(0, len(ids), 32)) and sum(r.length for r in rows) == len(ids)
        assert [r.ids_crc32 for r in rows] == [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in rows]


def _check(plan, count, capacity):
    bins = {}
    used = {s: np.zeros(n, int) for s, n in count.items()}
    for size, first, n, sequence, offset in plan.tolist():
        used[size][first:first + n] += 1
        for i in range(n):
            bins.setdefault(sequence + i, []).append((offset, size))
    assert all((u == 1).all() for u in used.values())
    for items in bins.values():
        items.sort()
        at = 0
        for offset, size in items:
            assert offset == at
            at += size
        assert at <= capacity and sum(3 * s > capacity for _, s in items) <= 2
    return len(bins)


def _best_fit_decreasing(count, capacity):
    gaps = []
    for size in sorted(count, reverse=True):
        for _ in range(count[size]):
            fits = [g for g in gaps if g >= size]
            if fits:
                gaps.remove(min(fits))
            gaps.append((min(fits) if fits else capacity) - size)
    return len(gaps)


def test_plans():
    rng = random.Random(1)
    for capacity in (12, 30, 100, 2048):
        for _ in range(30):
            count = {rng.randrange(1, capacity + 1): rng.choice([1, 2, 3, 40]) for _ in range(rng.randrange(1, 25))}
            n = _check(plan_packing(count, capacity), count, capacity)
            assert n <= _best_fit_decreasing(count, capacity)
    assert len(plan_packing({})) == 0
    assert _check(plan_packing({10: 4, 20: 4}, 30), {10: 4, 20: 4}, 30) == 4
    assert _check(plan_packing({1: 61}, 30), {1: 61}, 30) == 3


def test_whole_operator(spark):
    rng = random.Random(2)
    rows = [(i % 50 if i else None, " ".join(rng.choice(["one", "two", "three,"]) for _ in range(rng.choice([0, 3, 9, 25, 40, 90])))) for i in range(120)]
    rows += [rows[5]] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = best_fit_packing(docs, PATH, 64).collect()
    assert len(got) == pieces(docs, PATH, 64).count()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 64) * 1.1 + 1
    assert best_fit_packing(docs.where("false"), PATH, 64).count() == 0
