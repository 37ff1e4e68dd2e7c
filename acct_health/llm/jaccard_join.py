"""N-gram Jaccard join: which documents have a Jaccard similarity of 0.8 or more, as components.

A document's set holds its distinct five-word shingles (words of A-Z folded to a-z); a shorter text
is one shingle as a whole. Two documents link if 100 * intersection >= 80 * union.

1. Documents of equal text are one class from the start and link with each other.
2. A sharded count-min sketch (it only overestimates) tells each class which of its shingles may
   occur in another class. A class with fewer than 80 % such shingles links with nothing: it is done.
3. For the rest, exact frequencies order the shingles. Linked sets share one of each other's rarest
   n - ceil(0.8 n) + 1 shingles, so components over these hold all links of a class: a *family*.
4. Each family is searched by T-occurrence. Of a query's inverted lists, DivideSkip takes the
   longest ones apart; the short lists are merged and counted, documents that can still reach the
   overlap T are looked up in the long lists by binary search, and those that reach it are links.
   Documents already in the query's component are left out of the merge, so a family of copies costs
   a few probes per member and its pairs are never listed.
5. A family of more than ``PART_DOCS`` classes is cut into parts: each part is searched by itself,
   then against the first part. What is still outside the family's largest component is searched in
   parts by rarest shingle, and a text only goes to parts in which one of its prefix shingles is in a
   prefix. All pairs that could link and are not yet in one component are covered, whatever the
   family's size, and unlinked texts that share little more than a template meet few parts.

Defined results: null and empty texts and texts without words have an empty set, link with nothing
(not even with each other) and have their own id as component; rows of equal text and different ids
link; a null id never is a component's name unless all its ids are null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acct_health.llm.blocks import Layout, Sketch, answers_by_key, ask, block_texts, text_classes, text_hash
from acct_health.llm.common import hash_windows, hash_words, mix, read_table, stored, text_buffer, word_spans
from acct_health.llm.components import components

SHINGLE_WORDS = 5
PERCENT = 80
#: Classes searched together in one task.
PART_DOCS = 2000
#: Length of the prefix of a set's shared shingles, less those that are in no other class.
PREFIX = f"cast(size(shared) - (n * {PERCENT} + 99) div 100 + 1 as int)"
#: DivideSkip's constant for the number of lists set apart as long.
MU = 0.0085


class _Sets:
    """Shingle sets of one block: sorted distinct items, with ``first`` as each class's first item."""

    def __init__(self, table: pa.Table):
        self.h, texts, _ = block_texts(table)
        data, offsets = text_buffer(texts)
        starts, ends, first = word_spans(data, offsets)
        words = hash_words(data, starts, ends, lower=True)
        items, at = hash_windows(words, first, SHINGLE_WORDS)
        owner = np.searchsorted(first, at, side="right") - 1
        count = np.diff(first)
        for width in range(1, SHINGLE_WORDS):  # short texts: the whole sequence
            whole, at = hash_windows(words, first, width)
            text = np.searchsorted(first, at, side="right") - 1
            own = count[text] == width
            items = np.concatenate((items, mix(whole[own] + np.uint64(width))))
            owner = np.concatenate((owner, text[own]))
        order = np.lexsort((items, owner))
        items, owner = items[order], owner[order]
        if len(items):
            new = np.concatenate(([True], (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])))
            items, owner = items[new], owner[new]
        self.items, self.first = items, np.searchsorted(owner, np.arange(len(self.h) + 1))


_SETS = "h binary, n long, shared array<long>"


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(h, n, shared) per distinct text: the size of its set and, for texts that may have a link, its
    shingles that may occur in another text (null for the rest)."""
    layout = Layout.of(docs)
    classes = text_classes(docs, layout)
    sketch = Sketch(layout, rows=1)  # it only narrows the search; a second row would cost more than it saves

    def estimate(block: int, table: pa.Table) -> list[dict]:
        s = _Sets(table)
        return sketch.questions(block, s.items, np.ones(len(s.items), np.int64))

    def survivors(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        s = _Sets(table)
        hit = sketch.repeated(s.items, answers_by_key(got))
        n = np.diff(s.first)
        total = np.concatenate(([0], np.cumsum(hit)))
        may = (n > 0) & (100 * (total[s.first[1:]] - total[s.first[:-1]]) >= PERCENT * n)
        shared = [s.items[a:b][hit[a:b]].view(np.int64) if m else None
                  for a, b, m in zip(s.first[:-1], s.first[1:], may, strict=True)]
        return pa.table({"h": pa.array(s.h, pa.binary()), "n": pa.array(n, pa.int64()),
                         "shared": pa.array(shared, pa.list_(pa.int64()))})

    asked = ask(classes, estimate, sketch)
    return classes.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(survivors, _SETS)


def families(sets: DataFrame) -> DataFrame:
    """(uid, n, shared, family) for classes with a shingle of their prefix in another class; ``shared``
    has the shingles found in several classes, rarest first."""
    postings = sets.where("shared is not null").select("uid", "n", F.explode("shared").alias("s"))
    known = postings.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    ranked = postings.join(known, "s").groupBy("uid").agg(
        F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("df", "s"))), lambda x: x.s).alias("shared"))
    kept = stored(ranked.withColumn("p", F.expr(PREFIX)).where("p > 0"), "ranked")
    rare = kept.select("uid", F.explode(F.slice("shared", 1, F.col("p"))).alias("s"))
    edges = rare.join(rare.groupBy("s").agg(F.min("uid").alias("m")), "s").select(F.col("uid").alias("u"), F.col("m").alias("v"))
    found = components(edges)
    roots = found.unionByName(found.select(F.col("v").alias("u"), "v").distinct())
    return kept.drop("p").join(roots.select(F.col("u").alias("uid"), F.col("v").alias("family")), "uid")


class _Index:
    """Inverted lists of one task's classes and T-occurrence search among them."""

    def __init__(self, n: list[int], shared: list[np.ndarray], label: list[int]):
        self.n = np.array(n, np.int64)
        tokens, ids = np.unique(np.concatenate(shared), return_inverse=True)
        self.cut = np.concatenate(([0], np.cumsum([len(x) for x in shared])))
        self.ids = ids
        doc = np.repeat(np.arange(len(n)), np.diff(self.cut))
        order = np.argsort(ids, kind="stable")
        self.docs = doc[order]
        self.begin = np.searchsorted(ids[order], np.arange(len(tokens) + 1))
        self.keys = ids[order] * len(n) + self.docs  # sorted: a list's entries by document
        _, self.label = np.unique(np.array(label), return_inverse=True)
        self.links: list[tuple[int, int]] = []

    def _union(self, x: int, y: int) -> None:
        self.links.append((x, y))
        self.label[self.label == self.label[y]] = self.label[x]

    def _probe(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """In how many of ``lists`` each of ``docs`` is, by binary search."""
        if not len(lists) or not len(docs):
            return np.zeros(len(docs), np.int64)
        want = lists[:, None] * len(self.n) + docs[None, :]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return (self.keys[at] == want).sum(axis=0)

    def _similar(self, x: int, docs: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        return 100 * overlap >= PERCENT * (self.n[x] + self.n[docs] - overlap)

    def _merged(self, x: int, lists: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge of the lists: each document once, with its number of occurrences. Left out are those of
        x's component, of too different a size, or not ``among``. (A stable sort merges sorted runs.)"""
        if not len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        entries = np.concatenate([self.docs[self.begin[t]:self.begin[t + 1]] for t in lists])
        n = self.n[entries]
        fits = (self.label[entries] != self.label[x]) & (100 * n >= PERCENT * self.n[x]) & (100 * self.n[x] >= PERCENT * n)
        entries = np.sort(entries[fits & among[entries]], kind="stable")
        if not len(entries):
            return entries, entries
        at = np.flatnonzero(np.concatenate(([True], entries[1:] != entries[:-1])))
        return entries[at], np.diff(np.append(at, len(entries)))

    def search(self, x: int, among: np.ndarray) -> None:
        """Link x with every document ``among`` that is similar and not yet in its component."""
        lists = self.ids[self.cut[x]:self.cut[x + 1]]
        size = self.begin[lists + 1] - self.begin[lists]
        lists, size = lists[size > 1], size[size > 1]
        need = -(-int(self.n[x]) * PERCENT // 100)  # the overlap any link needs
        if len(lists) < need:
            return
        lists = lists[np.argsort(size, kind="stable")]
        long = min(need - 1, int(need / (MU * math.log2(max(2, int(size.max()))) + 1)))
        short, skipped = lists[:len(lists) - long], lists[len(lists) - long:]
        # a look at the component of the newest entry of the shortest list spares copies the whole merge
        for t in short[:3]:
            y = self.docs[self.begin[t]:self.begin[t + 1]]
            y = y[(self.label[y] != self.label[x]) & among[y]][-1:]
            if len(y) and self._similar(x, y, self._probe(lists, y))[0]:
                self._union(x, int(y[0]))
        docs, seen = self._merged(x, short, among)
        docs, seen = docs[seen >= need - long], seen[seen >= need - long]
        for i in range(0, len(docs), 256):
            part = docs[i:i + 256]
            part_seen = seen[i:i + 256][self.label[part] != self.label[x]]
            part = part[self.label[part] != self.label[x]]
            for y in part[self._similar(x, part, part_seen + self._probe(skipped, part))]:
                if self.label[y] != self.label[x]:
                    self._union(x, int(y))


LINKS = "u long, v long"


def _search(table: pa.Table) -> list[tuple[int, int]]:
    """Links of one task's rows (uid, n, shared, label, role): role 0 is looked up only by others,
    1 looks up all others, 2 looks up those of role 0."""
    rows = table.sort_by("uid")
    uid = rows.column("uid").to_pylist()
    role = np.array(rows.column("role").to_pylist(), np.int64)
    shared = rows.column("shared").combine_chunks()
    cut = np.asarray(shared.offsets)
    values = np.asarray(shared.values)
    index = _Index(rows.column("n").to_pylist(), [values[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)],
                   rows.column("label").to_pylist())
    everything, indexed = np.ones(len(uid), bool), role == 0
    for x in np.flatnonzero(role > 0):
        index.search(int(x), everything if role[x] == 1 else indexed)
    return [(uid[x], uid[y]) for x, y in index.links]


def _searched(rows: DataFrame, *keys: str) -> DataFrame:
    def task(table: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        family = table.column("family").to_pylist()
        if len(set(family)) == 1:
            links = _search(table)
        else:
            table = table.sort_by("family")
            family = table.column("family").to_pylist()
            at = [i for i in range(len(family)) if not i or family[i] != family[i - 1]] + [len(family)]
            for a, b in zip(at[:-1], at[1:], strict=True):
                links += _search(pa.Table.from_batches(table.slice(a, b - a).combine_chunks().to_batches()))
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})

    return rows.groupBy(*keys).applyInArrow(task, LINKS)


def links(found: DataFrame, part_docs: int = PART_DOCS) -> DataFrame:
    """(u, v): links enough to connect every component of linked classes."""
    sized = found.join(found.groupBy("family").agg(F.count("*").alias("size")), "family")
    rows = stored(sized.withColumn("parts", F.ceil(F.col("size") / part_docs)).withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("uid"), "parts")).otherwise(F.lit(0))), "families")
    total = rows.agg(F.count("*").alias("n"), F.max("parts").alias("parts")).first()
    # many small families share a task; a part of a large one is a task
    task = F.when(F.col("parts") > 1, F.col("family")).otherwise(
        F.pmod(F.xxhash64("family"), F.lit(max(1, total.n * 4 // part_docs))) - (1 << 40))
    out = stored(_searched(rows.withColumn("task", task).withColumn("label", F.col("uid")).withColumn("role", F.lit(1)),
                           "task", "part"), "links")
    if (total.parts or 0) <= 1:
        return out
    large = rows.where("parts > 1")
    # against the first part
    labelled = stored(_label(large, out), "labelled")
    first = labelled.where("part = 0").withColumn("task", F.explode(F.expr("sequence(1, parts - 1)"))).withColumn("role", F.lit(0))
    others = labelled.where("part > 0").withColumn("task", F.col("part")).withColumn("role", F.lit(2))
    out = stored(out.unionByName(_searched(first.unionByName(others), "family", "task")), "links")
    # whatever is outside a family's largest component, in groups, against every part
    labelled = stored(_label(large, out), "labelled")
    sizes = labelled.groupBy("family", "label").agg(F.count("*").alias("k"))
    most = sizes.groupBy("family").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("all"))
    open_ = labelled.join(most.where("top.k < all"), "family")
    return out.unionByName(_searched(routed(open_.withColumn("query", F.expr("label <> top.label")), part_docs),
                                     "family", "bucket", "piece", "g"))


def routed(rows: DataFrame, part_docs: int) -> DataFrame:
    """Tasks (family, bucket, piece, g) in which rows marked ``query`` (role 2) meet the rows of their family
    (role 0) that have a prefix shingle in common with them.

    Rows lie in pieces of about ``part_docs`` by their rarest shingle. A query goes to the pieces that hold
    one of its prefix shingles in a prefix; a piece is copied for every ``part_docs`` queries."""
    piece = ["family", "bucket", "piece"]
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.get("shared", F.lit(0)), F.lit(2)), "parts"))
    many = rows.groupBy("family", "bucket").agg(F.ceil(F.count("*") / part_docs).alias("pieces"))
    rows = rows.join(many, ["family", "bucket"]).withColumn("piece", F.pmod(F.xxhash64("uid", F.lit(3)), "pieces"))
    placed = stored(rows.select(*piece, "uid", "n", "shared", "label", "query"), "placed")
    prefix = F.explode(F.slice("shared", F.lit(1), F.expr(PREFIX))).alias("s")
    held = placed.select(*piece, prefix).distinct()
    routes = placed.where("query").select("family", "uid", prefix).join(held, ["family", "s"]).select(*piece, "uid").distinct()
    routes = stored(routes, "routes")
    load = routes.groupBy(*piece).agg(F.ceil(F.count("*") / part_docs).alias("groups"))
    columns = [*piece, "g", "uid", "n", "shared", "label", "role"]
    queries = routes.join(load, piece).join(placed.where("query").drop("bucket", "piece", "query"), ["family", "uid"]).withColumn(
        "g", F.pmod(F.xxhash64("uid", F.lit(1)), "groups")).withColumn("role", F.lit(2))
    index = placed.join(load, piece).withColumn("g", F.explode(F.expr("sequence(0, groups - 1)"))).withColumn("role", F.lit(0))
    return index.select(columns).unionByName(queries.select(columns))


def _label(rows: DataFrame, found: DataFrame) -> DataFrame:
    named = components(found).select(F.col("u").alias("uid"), F.col("v").alias("found"))
    return rows.drop("label").join(named, "uid", "left").withColumn("label", F.coalesce("found", "uid")).drop("found")


def jaccard_classes(docs: DataFrame, part_docs: int = PART_DOCS) -> DataFrame:
    """(h, n_shingles, class): distinct texts, the size of their set, and a number that linked texts
    have in common (null for an empty set)."""
    sets = stored(shingle_sets(docs).withColumn("uid", F.monotonically_increasing_id()), "sets")
    found = components(links(families(sets), part_docs))
    named = sets.select("h", F.col("n").alias("n_shingles"), "uid").join(
        found.select(F.col("u").alias("uid"), F.col("v").alias("root")), "uid", "left")
    return named.select("h", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "uid")).alias("class"))


def jaccard_join(docs: DataFrame, part_docs: int = PART_DOCS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    classes = stored(jaccard_classes(docs, part_docs), "classes")
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("h")).join(classes, "h").select("doc_id", "n_shingles", "class")
    least = stored(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least")), "least")
    return rows.join(least, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [1] ELSE range(1, len(ws) - 3) END) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.k + b.k - c)),
r AS (SELECT doc_id, doc_id AS z FROM w UNION SELECT e.y, r.z FROM r JOIN e ON e.x = r.doc_id)
SELECT w.doc_id, coalesce(n.k, 0)::BIGINT AS n_shingles, c.component_id
FROM w JOIN (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id) c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
