"""Best-fit packing of tokenized documents into sequences, large items matched first.

A document's ids (with an end id) are cut into pieces of the capacity only if it is longer. Pieces
above one third of the capacity go at most two to a sequence: from the largest on, each is matched
greedily with the largest that still fits beside it. The others, longest first, go where the gap is
smallest. Only lengths matter for that, so the plan is made from the histogram of lengths (at most
2048 numbers, whatever the corpus) and says, for the k-th piece of each length, its sequence and
offset. Pieces get their number within their length in Spark: pieces of one length are dealt over
buckets of about ``BUCKET_ROWS``, numbered there, and shifted by the sizes of the buckets before.

Defined results: a null or empty text is its end id alone; rows with equal or null ids are packed
each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acct_health.llm.common import read_table, stored
from acct_health.llm.wordcache import ChunkIds, expand, text_slices

CAPACITY = 2048
END_ID = 0
BUCKET_ROWS = 1000


class WordTokenizer:
    """A ``tokenizers`` file whose pre-tokenizer never joins across white space, chunk by chunk.

    Most chunks are letters with at most a stop after them: Arrow takes the stop off and folds case over a
    batch's distinct chunks, so that only distinct stems are looked up or tokenized one by one."""

    _PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
    _STOPS = ("", ".", ",")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        # letters alone are one pre-token each: for them the general pattern can be skipped
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        stops = [self.full.encode(p, add_special_tokens=False).ids if p else [] for p in self._STOPS] + [[END_ID]]
        self.fixed = np.array([i for ids in stops for i in ids], np.int32)
        self.fixed_length = np.array([len(ids) for ids in stops])
        self.stems, self.others = ChunkIds(self._encode_stems), ChunkIds(self._encode_others)

    def _encode_stems(self, stems: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(stems), 500):
            part = stems[i:i + 500]
            got = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<i4")
            ends = (4 * np.flatnonzero(self.last[got]) + 4).tolist()
            raw = got.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _encode_others(self, chunks: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.full.encode_batch_fast(chunks, add_special_tokens=False)]

    def forget(self) -> None:
        """Gives a task's memory back: the worker may wait long for its next one."""
        self.stems.forget()
        self.others.forget()
        pa.default_memory_pool().release_unused()

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct chunks one after the other, number of each one's ids)."""
        plain = pc.match_substring_regex(chunks, self._PLAIN)
        letters, rest = chunks.filter(plain), chunks.filter(pc.invert(plain))
        stop = pc.ends_with(letters, ".").to_numpy(zero_copy_only=False) + 2 * pc.ends_with(letters, ",").to_numpy(zero_copy_only=False)
        stems = pc.utf8_lower(pc.utf8_rtrim(letters, ".,")).dictionary_encode()
        # codes first: both caches may start anew then
        stem = self.stems.codes(stems.dictionary.to_numpy(zero_copy_only=False).tolist())[stems.indices.to_numpy()]
        other = self.others.codes(rest.to_numpy(zero_copy_only=False).tolist())
        sources = [self.stems.flat(), self.others.flat(), (self.fixed, np.cumsum(self.fixed_length) - self.fixed_length, self.fixed_length)]
        ids = np.concatenate([i for i, _, _ in sources])
        shift = np.cumsum([0] + [len(i) for i, _, _ in sources])
        begin, length = np.zeros((len(chunks), 2), np.int64), np.zeros((len(chunks), 2), np.int64)
        mask = plain.to_numpy(zero_copy_only=False)
        for at, part, code, (_, first, size), before in ((mask, 0, stem, sources[0], shift[0]), (~mask, 0, other, sources[1], shift[1]),
                                                         (mask, 1, stop, sources[2], shift[2])):
            begin[at, part], length[at, part] = first[code] + before, size[code]
        return ids[expand(begin.ravel(), length.ravel())], length.sum(axis=1)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with END_ID, one after the other; end of each text)."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        ids, length = self._chunk_ids(words.dictionary)
        ids, length = np.append(ids, np.int32(END_ID)), np.append(length, 1)
        begin = np.cumsum(length) - length
        own = np.insert(words.indices.to_numpy().astype(np.int64), ends, len(begin) - 1)
        tokens = length[own]
        total = np.concatenate(([0], np.cumsum(tokens)))
        return ids[expand(begin[own], tokens)], total[ends + np.arange(1, len(ends) + 1)]


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        for b in batches:
            for row, texts in text_slices(b.column("text")):
                ids, ends = tok.batch(texts)
                ids = ids.astype("<u4")
                size = np.diff(ends, prepend=0)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                at = (ends - size)[doc] + start
                crc = [zlib.crc32(ids[a:a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(row, len(texts)).cast(pa.int64()).take(pa.array(doc)),
                     pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
        tok.forget()

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def plan_packing(count: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first, n, sequence, offset): pieces ``first`` to ``first + n - 1`` of ``length`` go
    to as many sequences from ``sequence`` on, at ``offset``."""
    left = [0] * (capacity + 1)
    for size, n in count.items():
        left[size] = n
    used = [0] * (capacity + 1)
    gaps: dict[int, list[tuple[int, int]]] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(size: int, n: int, sequence: int, gap: int) -> int:
        rows.append((size, used[size], n, sequence, capacity - gap))
        used[size] += n
        left[size] -= n
        return gap - size

    def fill(size: int, n: int, sequence: int, gap: int, times: int) -> None:
        for _ in range(times):
            gap = put(size, n, sequence, gap)
        if gap:
            gaps.setdefault(gap, []).append((sequence, n))

    third = capacity // 3
    for size in range(capacity, third, -1):
        while left[size]:
            mate = next((m for m in range(min(size, capacity - size), third, -1) if left[m] > (m == size)), 0)
            n = left[size] if not mate else left[size] // 2 if mate == size else min(left[size], left[mate])
            gap = put(size, n, opened, capacity)
            if mate:
                gap = put(mate, n, opened, gap)
            if gap:
                gaps.setdefault(gap, []).append((opened, n))
            opened += n
    for size in range(third, 0, -1):
        while left[size]:
            gap = min((g for g in gaps if g >= size), default=capacity)
            times = gap // size
            # as many sequences as take `times` pieces each, then one that takes the remainder
            n, times = (left[size] // times, times) if left[size] >= times else (1, left[size])
            if gap == capacity:
                fill(size, n, opened, gap, times)
                opened += n
                continue
            sequence, there = gaps[gap].pop()
            if there > n:
                gaps[gap].append((sequence + n, there - n))
            elif not gaps[gap]:
                del gaps[gap]
            fill(size, min(n, there), sequence, gap, times)
    return np.array(rows, np.int64).reshape(-1, 5)


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (rows with a ``length`` of 1 to ``capacity``) with sequence_id and offset."""
    columns = found.columns
    found = stored(found.withColumn("__u", F.monotonically_increasing_id()), "pieces")
    count = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_packing(count, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    buckets = F.array(*[F.lit(-(-count.get(size, 0) // BUCKET_ROWS)) for size in range(1, capacity + 1)])
    dealt = found.withColumn("__b", F.pmod(F.xxhash64("__u"), F.greatest(F.element_at(buckets, F.col("length").cast("int")), F.lit(1))))
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "__b").agg(F.count("*").alias("n")).withColumn(
        "__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = dealt.withColumn("__k", F.row_number().over(Window.partitionBy("length", "__b").orderBy("__u")) - 1)
    ranked = numbered.join(sizes.drop("n"), ["length", "__b"]).withColumn("__k", F.col("__before") + F.col("__k"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(plan[:, 0], np.arange(capacity + 2))
        for b in batches:
            size, k = b.column("length").to_numpy(), b.column("__k").to_numpy()
            at = np.empty(len(size), np.int64)
            for s in np.unique(size):
                own = size == s
                at[own] = first[s] + np.searchsorted(plan[first[s]:first[s + 1], 1], k[own], side="right") - 1
            own_columns = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*own_columns, pa.array(plan[at, 3] + k - plan[at, 1]), pa.array(plan[at, 4])],
                [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name in columns) + ", sequence_id long, offset long"
    return ranked.select(*columns, "__k").mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return packed(pieces(docs, tokenizer, capacity), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
