"""Small helpers shared by the operators: table reading, tables stored between steps, word hashing.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, as in ``[^\\x20\\x09-\\x0D]+``. Since
those six are ASCII, words can be found in the UTF-8 bytes of a whole Arrow batch at once.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acct_health.session import scratch_path, ship_package

#: Bytes of text hashed at once; bounds the arrays of 8 bytes per byte of text.
SEGMENT_BYTES = 1 << 18
#: Bytes and rows of an Arrow batch on its way to or from Python.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000


def hash_share(column, seed: int, share: float):
    """Whether a row is within ``share`` of all rows by a hash of a column; shares as small as 2^-62 count."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 2) < F.lit(min(1 << 62, int((1 << 62) * share)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; workers get the package as they need it for the operators' Python steps, and whole texts
    in batches of bounded bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the lineage ends there, and a
    lost executor costs only the tasks of the step that follows."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte) of every word, and for each text the index of its first word (one more
    entry than texts)."""
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    first[cut] |= inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cut[cut > 0] - 1
    last[before] |= inside[before]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@functools.cache
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_BASES = [(6364136223846793005, 2862933555777941757), (3935559000370003845, 3202034522624059733)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each run, through one running sum."""
    n = len(values) + 1
    size = 1 << max(19, n.bit_length())  # one table serves nearly all calls
    total = np.zeros(n, np.uint64)
    np.cumsum(values * _powers(base, size)[:n - 1], dtype=np.uint64, out=total[1:])
    inverse = pow(base, -1, 1 << 64)
    return (total[ends] - total[starts]) * _powers(inverse, size)[starts]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, variant: int = 0,
               lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word (A-Z folded if ``lower``), segment by segment of the text."""
    letters = _letters(variant).copy()
    if lower:
        letters[65:91] = letters[97:123]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT_BYTES)))
        a = starts[i]
        part = letters[data[a:ends[j - 1]]]
        out[i:j] = _runs(part, starts[i:j] - a, ends[i:j] - a, _BASES[variant][0])
        i = j
    # the length keeps runs apart whose letters cancel
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hash_windows(words: np.ndarray, first: np.ndarray, width: int, variant: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words within one text, and the index of each one's first word.

    ``first`` has the index of each text's first word and the total at its end."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    valid = np.ones(n, bool)
    for back in range(1, width):  # a window that reaches into the next text is none
        at = first[1:-1] - back
        valid[at[(at >= 0) & (at < n)]] = False
    # text borders closer than `width` leave marks for every word before them, so all crossing windows go
    at = np.flatnonzero(valid)
    out = np.empty(len(at), np.uint64)
    step = 1 << 18
    for i in range(0, len(at), step):
        part = at[i:i + step]
        a, b = part[0], part[-1] + width
        out[i:i + step] = _runs(words[a:b], part - a, part - a + width, _BASES[variant][1])
    return mix(out), at
