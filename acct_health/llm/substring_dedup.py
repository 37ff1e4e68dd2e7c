"""Substring deduplication: words of any passage that occurs more than once are removed.

A window is ``width`` consecutive words of one document. A word goes if some window that covers it
has a word sequence that also starts elsewhere, in the same document or another one; windows are
judged on the input. Method: count-min prefilter. Blocks of documents make partial sketches of their
windows, shards merge them, and only windows whose estimate is two or more go into a second pass,
which groups them exactly (by 128 bits of the word sequence). A sketch only overestimates, so no
repeated window is lost. Documents with equal text are one class with a count from the start, so a
text with a thousand copies is hashed once per task that reads it and its windows count as repeated.

Defined results: null text is as empty; a document of fewer than ``width`` words keeps all of them;
rows with equal or null ids are judged each on its own; other columns, whatever their names, stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acct_health.llm.blocks import Exact, Layout, Sketch, answers_by_key, ask, ask_again, block_texts, text_classes, text_hash
from acct_health.llm.common import hash_windows, hash_words, read_table, text_buffer, word_spans

WIDTH = 35
_RESULT = "__h binary, n_words long, n_removed long, kept_sha256 string, kept string"


class _Windows:
    """Words and windows of one block."""

    def __init__(self, table: pa.Table, width: int):
        self.h, texts, count = block_texts(table)
        self.data, offsets = text_buffer(texts)
        self.starts, self.ends, self.first = word_spans(self.data, offsets)
        self.width = width
        self.a, self.at = hash_windows(hash_words(self.data, self.starts, self.ends), self.first, width)
        self.weights = np.repeat(count, np.diff(np.searchsorted(self.at, self.first)))

    def second(self, which: np.ndarray) -> np.ndarray:
        """The other 64 bits, for the windows picked."""
        b, _ = hash_windows(hash_words(self.data, self.starts, self.ends, 1), self.first, self.width, 1)
        return b[which]


def repeated_words(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """(__h, n_words, n_removed, kept_sha256, kept) for every distinct text of ``docs``; ``kept`` is the
    text left (words joined by one space), null where nothing is removed or unless ``with_text``."""
    layout = Layout.of(docs)
    classes = text_classes(docs, layout)
    sketch, exact = Sketch(layout), Exact(layout)

    def estimate(block: int, table: pa.Table) -> list[dict]:
        w = _Windows(table, width)
        return sketch.questions(block, w.a, w.weights)

    def candidates(block: int, table: pa.Table, got: dict) -> list[dict]:
        w = _Windows(table, width)
        which = sketch.repeated(w.a, got)
        return exact.questions(block, w.a[which], w.second(which), w.weights[which]) + _pass_on(block, which)

    def remove(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
        w = _Windows(table, width)
        got = answers_by_key(got)
        which = got.pop(-1) if -1 in got else np.zeros(len(w.a), bool)
        repeated = np.zeros(len(w.a), bool)
        repeated[which] = exact.repeated(w.a[which], w.second(which), got)
        cover = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(cover, w.at[repeated], 1)
        np.add.at(cover, w.at[repeated] + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        return _judged(w, gone, with_text)

    asked = ask(classes, estimate, sketch)
    answered = ask_again(classes, asked, candidates, exact)
    return classes.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(remove, _RESULT)


def _pass_on(block: int, which: np.ndarray) -> list[dict]:
    """The prefilter's verdict, sent along to the last step (under a key of the block's own)."""
    if not len(which):
        return []
    bits = pa.compress(pa.py_buffer(np.packbits(which)), "zstd", asbytes=True)
    return [{"key": -1 - block, "block": block, "n": len(which), "first": bits, "second": None, "twice": None}]


def _judged(w: _Windows, gone: np.ndarray, with_text: bool) -> pa.Table:
    rows: dict[str, list] = {"__h": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
    removed = np.concatenate(([0], np.cumsum(gone)))
    whole = w.data.tobytes()
    for i, h in enumerate(w.h):
        a, b = int(w.first[i]), int(w.first[i + 1])
        n = int(removed[b] - removed[a])
        if n == 0:
            kept = b" ".join(whole[w.starts[a]:w.ends[b - 1]].split()) if b > a else b""
        else:
            left = np.flatnonzero(~gone[a:b]) + a
            kept = b" ".join([whole[s:e] for s, e in zip(w.starts[left].tolist(), w.ends[left].tolist(), strict=True)])
        rows["__h"].append(h)
        rows["n_words"].append(b - a)
        rows["n_removed"].append(n)
        rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        rows["kept"].append(kept.decode() if with_text and n else None)
    return pa.table({"__h": pa.array(rows["__h"], pa.binary()), "n_words": pa.array(rows["n_words"], pa.int64()),
                     "n_removed": pa.array(rows["n_removed"], pa.int64()),
                     "kept_sha256": pa.array(rows["kept_sha256"], pa.string()), "kept": pa.array(rows["kept"], pa.string())})


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` (and ``n_chars``, if there is one, to match); a
    text that loses no word stays as it was."""
    found = repeated_words(docs, width).where("n_removed > 0").select("__h", F.col("kept").alias("__kept"))
    joined = docs.withColumn("__h", text_hash(F.col("text"))).join(found, "__h", "left")
    new = {"text": F.coalesce("__kept", "text"), "n_chars": F.coalesce(F.length("__kept").cast("long"), "n_chars")}
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_words(docs, with_text=False).drop("kept")
    return docs.select("doc_id", text_hash(F.col("text")).alias("__h")).join(found, "__h").drop("__h")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
           FROM documents),
n AS (SELECT doc_id, ws, len(ws) AS n_words FROM w),
s AS (SELECT doc_id, ws, n_words, unnest(range(1, n_words - 33)) AS p FROM n WHERE n_words >= 35),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + 34], ' ') AS seq FROM s),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY seq) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM r, (SELECT unnest(range(0, 35)) AS k)),
per AS (SELECT doc_id, list(i) AS cut FROM gone GROUP BY doc_id)
SELECT n.doc_id, n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN cut IS NULL THEN ws
              ELSE list_transform(list_filter(range(1, n_words + 1), lambda i: NOT list_contains(cut, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256
FROM n LEFT JOIN per USING (doc_id)
"""
