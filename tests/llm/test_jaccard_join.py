"""Jaccard join against brute force, with families larger than a part, and odd rows."""

import random

from acct_health.llm import blocks
from acct_health.llm.components import components
from acct_health.llm.jaccard_join import families, jaccard_join, routed, shingle_sets

from pyspark.sql import functions as F


def _sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def _expected(rows):
    sets = [_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(s), (least.get(find(i), -1) if s else (d if d is not None else -1)))
                  for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def _got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in df.collect())


def _corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    passage = rng.choices(words, k=60)  # shared by texts that don't link
    for base in range(6):
        text = rng.choices(words, k=rng.randrange(20, 160))
        for _ in range(rng.choice([1, 3, 12, 30])):
            copy = list(text)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.2:
                copy = copy[:-rng.randrange(1, 15)]
            rows.append(" ".join(copy))
    rows += [" ".join(passage + rng.choices(words, k=15)) for _ in range(25)]
    rows += ["a b c d e", "A B c d E", "a b c", "A b\tc", "a b", "x", "", " \n", None, None, "a b c d e f g h i j", "a b c d e f g h i j k"]
    rng.shuffle(rows)
    return [(i + 10 if t != "x" else None, t) for i, t in enumerate(rows)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'h' as h", "1L as n", "2L as uid", "3 as class")


def test_brute_force(spark):
    rows = _corpus()
    assert _got(jaccard_join(_frame(spark, rows))) == _expected(rows)


def test_families_cut_into_parts(spark):
    rows = _corpus()
    assert _got(jaccard_join(_frame(spark, rows), part_docs=5)) == _expected(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (9, "")]
    assert _got(jaccard_join(_frame(spark, rows))) == [(3, 2, 3), (7, 2, 3), (7, 2, 3), (9, 0, 9)]
    assert jaccard_join(_frame(spark, rows).where("false")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40, 31), (31, 35), (35, 35), (None, 3), (2, 1)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.u, r.v) for r in got) == sorted([(i, 0) for i in range(1, 21)] + [(35, 31), (40, 31)])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_relays_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(blocks, "SHARD_ITEMS", 100)
    monkeypatch.setattr(blocks, "DIRECT_SHARDS", 2)
    rows = _corpus()
    assert _got(jaccard_join(_frame(spark, rows))) == _expected(rows)


def _unlinked(n):
    """Texts of 100 words, each sharing 70 with the next: none links, and they are one family."""
    return [(i, " ".join(f"s{k}" for k in range(30 * i, 30 * i + 100))) for i in range(n)]


def test_a_family_without_links_is_copied_in_proportion(spark):
    """Where no text links, all are queries; copies must not grow with the square of the family."""
    copies = {}
    for n in (500, 2000):
        sets = shingle_sets(_frame(spark, _unlinked(n))).withColumn("uid", F.monotonically_increasing_id())
        found = families(sets).persist()
        size = found.groupBy("family").count().agg(F.max("count")).first()[0]
        assert size > 0.8 * n
        rows = found.withColumn("parts", F.ceil(F.lit(size / 10))).withColumn("label", F.col("uid")).withColumn("query", F.lit(True))
        copies[n] = routed(rows, 10).count() / size
    assert copies[2000] < 1.2 * copies[500]


def test_many_unlinked_texts_and_links_among_them(spark):
    rows = _unlinked(900)
    rows += [(2000 + i, rows[i * 7][1] + " end") for i in range(100)]
    got = _got(jaccard_join(_frame(spark, rows), part_docs=20))
    assert got == _expected(rows) and sum(c != d for d, _, c in got) >= 100


def test_one_rarest_shingle_of_all(spark):
    """All texts have the same rarest shingles, so the parts are cut by number."""
    rng = random.Random(6)
    rows = [(i, " ".join(["t u v w x y"] + [f"w{rng.randrange(3)}q{k}" for k in range(20)])) for i in range(150)]
    assert _got(jaccard_join(_frame(spark, rows), part_docs=10)) == _expected(rows)
