"""SimHash near-dedup against all pairs of fingerprints."""

import random

import numpy as np
import pytest
import xxhash

from acct_health.llm import simhash_dedup
from acct_health.llm.simhash_dedup import Forest, bands, fingerprint, file_entries, links, op12_simhash_dedup, simhash_classes

SMALL = "/root/testdata/sf0.001"
BLANKS = "\t\n\x0b\x0c\r"


def _plain(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in BLANKS else c for c in text or "")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(rows, radius=2):
    fps = [_plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted([(d, f"{fps[i]:016x}", least.get(top(i))) for i, (d, _) in enumerate(rows)], key=str)


def _got(df):
    return sorted([(r.doc_id, r.fingerprint, r.component_id) for r in df.collect()], key=str)


def test_fingerprints():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "One", "two Words", "ÀÉ Żółć 日本  x", "a  b\x0bc\r\nd", "the same " * 999]
    texts += [" ".join(rng.choice(["Alpha", "beta", "ß", "γ.", "x" * 40]) for _ in range(n)) for n in (3, 4, 600, 2000)]
    assert [fingerprint(t) for t in texts] == [_plain(t) for t in texts]


def test_runs_of_a_long_text(monkeypatch):
    text = " ".join(str(i * i % 997) for i in range(5000))
    whole = fingerprint(text)
    monkeypatch.setattr(simhash_dedup, "RUN", 700)
    assert fingerprint(text) == whole == _plain(text)


def test_classes_with_odd_rows(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(12)]
    rows = [(i, " ".join(base[i % 12])) for i in range(40)]
    for i in range(40, 160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i if i % 9 else None, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n"), (7, rows[7][1]), (7, "another"), (None, "alone here")]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id long, text string, fp string, u int, component_id int")
    got = _got(simhash_classes(df))
    assert got == _classes(rows)
    assert any(f != g and a == b for _, f, a in got for _, g, b in got)  # links between different fingerprints


def test_empty_table(spark):
    assert simhash_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _near(fps, radius):
    return {(a, b) for a in fps for b in fps if a < b and 0 < (a ^ b).bit_count() <= radius}


@pytest.mark.parametrize(("radius", "max_tree", "shard"), [(2, 20, 64), (1, 30, 1000)])
def test_links_of_crowded_bands(spark, radius, max_tree, shard):
    """Fingerprints that agree in whole bands: values are filed again and again."""
    rng = random.Random(radius)
    fps = {0, 2 ** 64 - 1, 2 ** 63}
    for _ in range(6):
        x = rng.getrandbits(64)
        fps |= {x ^ sum(1 << rng.randrange(40, 64) for _ in range(rng.randint(0, 3))) & (2 ** 64 - 1) for _ in range(40)}
    fps |= {rng.getrandbits(12) for _ in range(100)}
    signed = [(x - 2 ** 64 if x >> 63 else x,) for x in fps]
    entries = spark.createDataFrame(signed, "fp long")
    got = [tuple(x % 2 ** 64 for x in r) for r in links(entries, radius, max_tree, shard).collect()]
    assert len(got) == len(set(got)) and set(got) == _near(fps, radius)
    assert file_entries(entries, radius, max_tree).groupBy("path", "value").count().agg({"count": "max"}).first()[0] <= max_tree


def test_bands_cover_the_bits():
    first = bands((), 3)
    assert sum(first) == 2 ** 64 - 1
    assert sum(bands((first[1],), 3)) == 2 ** 64 - 1 - first[1]


def test_tree_follows_few_edges():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 63, 4000, np.uint64))
    forest = Forest.grow(fps, np.zeros(len(fps), np.int64))
    assert len(forest.child) == len(fps) - 1 and len(np.unique(forest.edge)) == len(forest.edge)
    seen = []
    plain = simhash_dedup.distance
    try:
        simhash_dedup.distance = lambda a, b: (seen.append(len(a)), plain(a, b))[1]
        list(forest.near(fps[:200], np.zeros(200, np.int64), 2))
    finally:
        simhash_dedup.distance = plain
    assert sum(seen) < 200 * len(fps) / 2


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(op12_simhash_dedup(spark, SMALL)) == _classes(rows)
