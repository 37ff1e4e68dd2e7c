"""SentencePiece encoding and decoding that keeps the original byte span of every piece.

Normalisation: at each place the longest key of the model's compiled character map (a double-array
trie with its replacement strings) is replaced, other characters stand for themselves; then white
space is trimmed, prefixed and escaped as the model says. Every normalised character records which
source bytes it comes from, so a piece's span goes from its first character's source to the source of the
character that follows. Spans follow one another and cover the text; bytes that the normaliser drops
belong to the span before them (leading ones to none). A source character that becomes several
pieces gives its bytes to the last of them, the others are empty spans before it.

Segmentation: pieces never join a character other than the space mark to a following space mark
(unless a piece of the vocabulary does, which is looked up), nor a character that no piece contains
to any other. So the normalised text is cut there and each distinct chunk is segmented once, by the
library's merge rules. Decoding puts the ids' pieces together, byte pieces as UTF-8 (invalid bytes
as U+FFFD), and drops the prefix mark.

Defined results: null is as the empty text, which has the end id alone and decodes to nothing; rows
with equal or null ids are encoded each by itself.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from acct_health.llm.common import read_table, text_buffer
from acct_health.llm.wordcache import ChunkIds, expand, text_slices

MARK = "▁"


class CharacterMap:
    """The compiled map: a little-endian size, a double-array trie of that many bytes, and replacement
    strings ended by NUL, which the trie's values point into."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.strings = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that ``text`` has at ``at``."""
        units, best = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                value = units[node] & 0x7FFFFFFF
                best = i + 1 - at, self.strings[value:self.strings.index(b"\0", value)]
        return best


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        model = sentencepiece_model_pb2.ModelProto.FromString(blob)
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        if model.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("models with a suffix mark or unescaped spaces are not supported")
        self.end = model.trainer_spec.eos_id
        # the merge rules alone: this copy of the model must not normalise again
        model.normalizer_spec.Clear()
        model.normalizer_spec.name = "identity"
        model.normalizer_spec.add_dummy_prefix = False
        model.normalizer_spec.remove_extra_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        kinds = type(model.pieces[0])
        self.surface = [p.piece.encode() if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else b"" for p in model.pieces]
        self.byte = {i: int(p.piece[1:-1], 16) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        for i, value in self.byte.items():
            self.surface[i] = bytes([value])
        if any(p.type == kinds.USER_DEFINED for p in model.pieces) or not self.byte:
            raise ValueError("models with user-defined pieces or without byte pieces are not supported")
        text = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
        self.joins_mark = any(a != MARK and b == MARK for p in text for a, b in zip(p, p[1:], strict=False))
        self.loose = "" if any("\n" in p for p in text) else "\n"
        self.piece_bytes = np.array([len(s) for s in self.surface], np.int64)
        marks = np.array([s.count(MARK.encode()) for s in self.surface], np.int64)
        self.source_bytes = self.piece_bytes - (len(MARK.encode()) - 1) * marks
        self.cache = ChunkIds(self._segment)

    # -- normalisation ------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its UTF-8 bytes and its end, the source byte it is at."""
        source = text.encode()
        out, at = bytearray(), []
        i = 0
        lead = self.trim
        while i < len(source):
            found = self.map.longest(source, i) if self.map else None
            if found:
                n, new = found
            else:
                n = 1 if source[i] < 128 else 2 if source[i] < 224 else 3 if source[i] < 240 else 4
                new = source[i:i + n]
            for c in new.decode():
                if c == " ":
                    if lead:
                        continue
                    lead = self.trim
                    c = MARK
                else:
                    lead = False
                raw = c.encode()
                out += raw
                at += [i] * len(raw)
            i += n
        end = len(source)
        if self.trim:
            while out.endswith(MARK.encode()):
                end = at[-3]
                del out[-3:], at[-3:]
        if self.prefix and out:
            out[:0] = MARK.encode()
            at[:0] = [at[0]] * 3
        return out.decode(), np.array([*at, end], np.int64)

    def _plain(self, texts: pa.Array) -> pa.Array:
        """Normalised texts of a model without a character map or trimming: marks for spaces."""
        marked = pc.replace_substring(texts, " ", MARK)
        if not self.prefix:
            return marked
        return pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(MARK, marked, ""))

    # -- segmentation -------------------------------------------------------------------------------

    def _segment(self, chunks: list[str]) -> list[bytes]:
        return [array("i", ids).tobytes() for ids in self.segmenter.encode(chunks, num_threads=1)]

    def _chunks(self, normal: pa.Array) -> pa.Array:
        """Chunks of each normalised text: a run of marks with what follows it, or a loose character."""
        if self.joins_mark:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(normal) + 1), pa.int32()), normal)
        cut = pc.replace_substring_regex(normal, f"([^{MARK}\0]){MARK}", f"\\1\0{MARK}")
        if self.loose:
            cut = pc.replace_substring(cut, self.loose, f"\0{self.loose}\0")
        return pc.split_pattern(cut, "\0")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, end of each text), without end ids."""
        plain = self.map is None and not self.trim
        normal = self._plain(texts) if plain else pa.array([self.normalise(t)[0] for t in texts.to_pylist()], pa.string())
        if pc.any(pc.match_substring(normal, "\0")).as_py():  # NUL is the separator: such texts stay whole
            has = pc.match_substring(normal, "\0")
            split = self._chunks(pc.if_else(has, "", normal)).to_pylist()
            split = [[t] if h else s for t, h, s in zip(normal.to_pylist(), has.to_pylist(), split, strict=True)]
            split = pa.array(split, pa.list_(pa.string()))
        else:
            split = self._chunks(normal)
        chunks = split.flatten().dictionary_encode()
        codes = self.cache.codes(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()] if len(chunks) else np.zeros(0, np.int64)
        ids, begin, length = self.cache.flat()
        n = length[codes]
        total = np.concatenate(([0], np.cumsum(n)))
        ends = total[np.cumsum(pc.list_value_length(split).to_numpy())]
        return ids[expand(begin[codes], n)], ends

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Source byte at the end of each piece of one text; a piece starts where the one before ends."""
        _, at = self.normalise(text)
        return at[np.cumsum(self.piece_bytes[ids])]

    def batch_spans(self, texts: pa.Array, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``spans`` of all texts one after the other."""
        if self.map is not None or self.trim:
            parts = [self.spans(t, own) for t, own in zip(texts.to_pylist(), np.split(ids, ends[:-1]), strict=True)]
            return np.concatenate([*parts, np.zeros(0, np.int64)])
        # only marks differ in length from their source, and the prefix has none
        data, offsets = text_buffer(texts)
        begin = np.concatenate(([0], ends[:-1]))
        total = np.concatenate(([0], np.cumsum(self.source_bytes[ids])))
        count = np.diff(ends, prepend=0)
        out = total[1:] - np.repeat(total[begin], count) - int(self.prefix)
        for row in np.flatnonzero(pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)):
            out[begin[row]:ends[row]] = self.spans(texts[int(row)].as_py(), ids[begin[row]:ends[row]])
        place = out + np.repeat(offsets[:-1], count)
        for _ in range(3):  # a piece that ends within a character ends before it
            inside = place < np.repeat(offsets[1:], count)
            inside[inside] = data[place[inside]] & 0xC0 == 0x80
            out[inside] -= 1
            place[inside] -= 1
        return out

    # -- decoding -----------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.surface[i] for i in ids])
        text = raw.decode(errors="replace") if self.byte else raw.decode()
        if (self.prefix or self.trim) and text.startswith(MARK):
            text = text[1:]
        return text.replace(MARK, " ")


@functools.cache
def _codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, ends): the ids with an end id, and the byte of the text at which each one's span
    ends; it starts where the one before ends."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            for row, texts in text_slices(b.column("text")):
                ids, ends = codec.encode(texts)
                at = codec.batch_spans(texts, ids, ends)
                size = pc.binary_length(texts).to_numpy()
                offsets = pa.array(np.concatenate(([0], ends + np.arange(1, len(ends) + 1))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(row, len(texts)).cast(pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(np.insert(ids, ends, codec.end), pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(np.insert(at, ends, size), pa.int64()))],
                    ["doc_id", "ids", "ends"])

    return docs.select("doc_id", "text").mapInArrow(batch, "doc_id long, ids array<int>, ends array<long>")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32): what ``encode`` gives and what its ids
    decode to, as digests made beside them (token lists don't travel back to Spark for that)."""

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        decimal = [str(i) for i in range(len(codec.surface))]
        for b in batches:
            for row, texts in text_slices(b.column("text")):
                ids, ends = codec.encode(texts)
                at = codec.batch_spans(texts, ids, ends).astype("<u4")
                n, names, decoded, spans = [], [], [], []
                flat = ids.tolist()
                a = 0
                for e in ends.tolist():
                    own = flat[a:e]
                    n.append(len(own) + 1)
                    names.append(hashlib.sha256(" ".join([*map(decimal.__getitem__, own), decimal[codec.end]]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(own).encode()).hexdigest())
                    spans.append(zlib.crc32(at[a:e]))
                    a = e
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(row, len(texts)).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(names, pa.string()),
                     pa.array(decoded, pa.string()), pa.array(spans, pa.int64())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        batch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")


def op3_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
