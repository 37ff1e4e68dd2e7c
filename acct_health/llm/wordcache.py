"""Tokens of whole batches from the tokens of their distinct chunks.

Tokenizers that never join across certain places can work chunk by chunk. A batch is cut there, its
distinct chunks are looked up or tokenized once, and NumPy expands them to the batch's token ids.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks that a task remembers between batches, and bytes of text expanded at once.
CACHE_CHUNKS = 250_000
SLICE_BYTES = 2 << 20


class ChunkIds:
    """Ids of chunks: ``encode`` gives the ids (little-endian 32-bit numbers) of each of a list of new chunks."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHE_CHUNKS):
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.length: list[np.ndarray] = []
        self._flat = None

    def codes(self, chunks: list[str]) -> np.ndarray:
        """The chunks' codes, valid until the next call."""
        if len(self.code) > self.limit:
            self.forget()
        new = [c for c in chunks if c not in self.code]
        if new:
            collecting = gc.isenabled()
            gc.disable()  # a million small lists at once make no cycles, and the collector slow
            try:
                got = self.encode(new)
                n = len(self.code)
                self.code.update(zip(new, range(n, n + len(new)), strict=True))
                self.length.append(np.fromiter(map(len, got), np.int64, len(got)) // 4)
                self.ids.append(np.frombuffer(b"".join(got), "<i4"))
                del got
            finally:
                if collecting:
                    gc.enable()
            self._flat = None
        return np.fromiter(map(self.code.__getitem__, chunks), np.int64, len(chunks))

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, length) over the codes."""
        if self._flat is None:
            if not self.length:
                return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.ids, self.length = [np.concatenate(self.ids)], [np.concatenate(self.length)]
            end = np.cumsum(self.length[0])
            self._flat = self.ids[0], end - self.length[0], self.length[0]
        return self._flat


def expand(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices begin[i], begin[i] + 1, ... (length[i] of them) one after the other."""
    end = np.cumsum(length)
    return np.repeat(begin - (end - length), length) + np.arange(end[-1] if len(end) else 0)


def text_slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of at most about SLICE_BYTES each; nulls as empty."""
    column = pc.fill_null(column, "")
    size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_BYTES)))
        yield i, column.slice(i, j - i)
        i = j
