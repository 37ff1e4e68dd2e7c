"""The codec against the sentencepiece library, with and without a compiled character map."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from acct_health.llm.sentencepiece_codec import CharacterMap, Codec, digests, encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "  a  b ", "one two\n\nthree\t four", "\n", "x\n y", "▁", "a▁b ▁c", "\0a\0 b", "日本語 テキスト", "🙂🙂 é", "É!! 12 345",
         "</s><s><unk>", "a\r\n};\r\nb", "ﬁ ½ ①", "x" * 3000, "ab " * 2000, "a b c"]


def _random_texts():
    rng = random.Random(5)
    letters = "ab e  \n\t▁éß日🙂.,;#\0'"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)]


def test_matches_the_library():
    library, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), Codec(MODEL)
    texts = TEXTS + _random_texts()
    ids, ends = codec.encode(pa.array(texts))
    for text, own in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert own.tolist() == library.encode(text)
        assert codec.decode(own.tolist()) == library.decode(own.tolist())


def test_spans_cover_the_text():
    codec = Codec(MODEL)
    texts = TEXTS + _random_texts()
    ids, ends = codec.encode(pa.array(texts))
    at = codec.batch_spans(pa.array(texts), ids, ends)
    for text, own, spans in zip(texts, np.split(ids, ends[:-1]), np.split(at, ends[:-1]), strict=True):
        raw = text.encode()
        assert spans.tolist() == codec.spans(text, own).tolist()
        assert not len(own) and not raw or spans[-1] == len(raw)
        a = 0
        for i, e in zip(own.tolist(), spans.tolist(), strict=True):
            piece = codec.surface[i].decode(errors="ignore")
            if i not in codec.byte and e > a:
                assert raw[a:e].decode().replace("▁", " ") in (piece.replace("▁", " "), piece.replace("▁", " ")[1:])
            a = e


def _double_array(keys: dict[bytes, int]) -> bytes:
    """A small double-array trie in the layout of compiled character maps."""
    units = [0] * 4096
    used = {0}

    def build(node: int, entries: list[tuple[bytes, int]]) -> None:
        labels = sorted({k[0] if k else 0 for k, _ in entries})
        base = next(b for b in range(256, 4096, 256) if all(b ^ c not in used for c in labels))
        used.update(base ^ c for c in labels)
        units[node] |= (node ^ base) << 10
        for c in labels:
            rest = [(k[1:], v) for k, v in entries if (k[0] if k else 0) == c]
            if c == 0 and any(not k for k, _ in entries):
                units[base] = 0x80000000 | next(v for k, v in entries if not k)
                units[node] |= 0x100
            else:
                units[base ^ c] |= c
                build(base ^ c, rest)

    build(0, sorted(keys.items()))
    return b"".join(u.to_bytes(4, "little") for u in units)


def _with_map(tmp_path, trim: bool):
    rules = {"ﬁ": "fi", "①": "1", " ": " ", "é": "e", "ab": "X", "abc": "long", "\t": " ", "​": ""}
    strings, values = b"", {}
    for k, v in rules.items():
        values[k.encode()] = len(strings)
        strings += v.encode() + b"\0"
    trie = _double_array(values)
    blob = len(trie).to_bytes(4, "little") + trie + strings
    model = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    model.normalizer_spec.name = "own"
    model.normalizer_spec.precompiled_charsmap = blob
    model.normalizer_spec.remove_extra_whitespaces = trim
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    return str(path), blob


@pytest.mark.parametrize("trim", [False, True])
def test_compiled_character_map(tmp_path, trim):
    path, blob = _with_map(tmp_path, trim)
    assert CharacterMap(blob).longest(b"xabcd", 1) == (3, b"long")
    assert CharacterMap(blob).longest("xabd".encode(), 1) == (2, b"X")
    assert CharacterMap(blob).longest(b"xyz", 0) is None
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path)
    texts = ["ﬁne  abc ab é①", " a\tb ", "abab abcab", "​x​", "", "  ", *_random_texts()]
    ids, ends = codec.encode(pa.array(texts))
    for text, own in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert own.tolist() == library.encode(text), text
    text = "ﬁ abc"
    normal, at = codec.normalise(text)
    assert normal == "▁fi▁long" and at.tolist()[:5] == [0, 0, 0, 0, 0] and at[-1] == len(text.encode())


def test_frames(spark):
    rows = [(1, "a b"), (1, None), (None, ""), (2, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids")
    got = digests(docs, MODEL).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 1), (1, 3), (2, 3)]
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256(t).hexdigest() for t in (b"", b"a b")}
    whole = {r.doc_id: r for r in encode(docs.where("text = 'a b'"), MODEL).collect()}
    assert whole[1].ends == [1, 3, 3] and len(whole[1].ids) == 3
    assert digests(docs.where("false"), MODEL).count() == 0
