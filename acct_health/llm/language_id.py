"""Language identification by error-correcting output codes over byte n-gram classifiers.

Each language has a codeword of bits; for every bit a binary classifier (naive Bayes over hashed
three-byte grams of the folded text) gives the mean log ratio of its two sides. Decoding weighs each
bit's loss by how far apart its classifier keeps the mean texts of the two sides' languages, and takes the
language of the codeword with the least loss. The score is that language's share of exp(-loss); a text whose two
nearest codewords lie close together is flagged as ambiguous.

The classifiers are fitted on at most ``TRAIN_PER_LANGUAGE`` rows of each language, picked by a hash of
their id; that bounds the fit, not the prediction, which reads every whole text. Learning uses text
and lang of rows with crc32(doc_id) % 4 <> 2 only, and a prediction uses the text only.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if no
row can be learnt from. With one language learnt, all other texts get it. A null id is never learnt
from and not held out. Rows with equal ids are judged each by itself.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acct_health.llm.common import hash_share, read_table, text_buffer
from acct_health.llm.wordcache import text_slices

TRAIN_PER_LANGUAGE = 2000
GRAM_BITS = 14
#: Loss per bit grows by this per nat of mean log ratio.
SHARPNESS = 8.0
#: Two codewords closer than this share of exp(-loss) make a text ambiguous.
AMBIGUOUS = 0.6

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def held_out():
    """Rows kept out of learning, by id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def codewords(n: int) -> np.ndarray:
    """A row of +-1 for each of ``n`` languages: all splits for up to 6, else dense rows far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int64)
    if n <= 6:
        bits = np.arange(1, 2 ** (n - 1))
        return np.where((bits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1)
    width, rng, best, most = int(12 * np.ceil(np.log2(n))), np.random.default_rng(11), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, width))
        apart = int(((code[:, None] != code[None]).sum(2) + width * np.eye(n, dtype=np.int64)).min())
        split = (abs(code.sum(0)) < n).all()  # every bit has two sides
        if split and apart > most:
            best, most = code, apart
    return best


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram numbers of all texts, end of each text); a space stands for whatever is no letter."""
    data, offsets = text_buffer(pc.utf8_lower(texts))
    folded = _FOLD[data].astype(np.uint32)
    n = max(0, len(folded) - 2)
    gram = (folded[:n] * np.uint32(2654435761) ^ folded[1:n + 1] * np.uint32(2246822519) ^ folded[2:n + 2] * np.uint32(3266489917))
    gram = (gram * np.uint32(668265263)) >> np.uint32(32 - GRAM_BITS)
    inside = np.ones(n, bool)
    for back in (1, 2):
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < n)]] = False
    blank = (folded[:n] == 32) & (folded[1:n + 1] == 32)
    total = np.concatenate(([0], np.cumsum(inside & ~blank)))
    return gram[inside & ~blank], total[np.minimum(offsets[1:], n)]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # bits x grams
    bias: np.ndarray
    trust: np.ndarray  # of each bit, sums to 1

    def margins(self, texts: pa.Array) -> np.ndarray:
        """texts x bits: mean log ratio of each bit's two sides."""
        gram, end = _grams(texts)
        n = np.diff(end, prepend=0)
        out = np.zeros((len(texts), len(self.weights)))
        full = np.flatnonzero(n)
        start = (end - n)[full]
        for bit, weight in enumerate(self.weights):
            if len(full):
                out[full, bit] = np.add.reduceat(weight[gram], start) / n[full]
        return out - self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, ambiguous) from the bits' margins."""
        agree = margins[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -SHARPNESS * agree) * self.trust).sum(axis=2) * self.code.shape[1]
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        score = share.max(axis=1) / share.sum(axis=1)
        return loss.argmin(axis=1), score, score < AMBIGUOUS


def _any(conditions: list) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model | None:
    """Learns from rows of ``docs`` that are not held out (their text and lang)."""
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(found)
    if not languages:
        return None
    sample = rows.where(_any([(F.col("lang") == lang) & hash_share("doc_id", 5, per_language / found[lang]) for lang in languages]))
    number = {lang: i for i, lang in enumerate(languages)}
    size = 1 << GRAM_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each language's gram counts in the task's rows, a row counting as much as any other."""
        total, n = np.zeros((len(languages), size)), np.zeros(len(languages))
        for b in batches:
            lang = np.array([number[x] for x in b.column("lang").to_pylist()])
            for row, texts in text_slices(b.column("text")):
                gram, end = _grams(texts)
                begin = np.concatenate(([0], end[:-1]))
                for i in np.flatnonzero(end > begin):
                    own = np.bincount(gram[begin[i]:end[i]], minlength=size)
                    total[lang[row + i]] += own / own.sum()
                    n[lang[row + i]] += 1
        for i in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays([pa.array([languages[i]]), pa.array([total[i].tolist()], pa.list_(pa.float64()))], ["lang", "c"])

    parts = sample.select("lang", "text").mapInArrow(count, "lang string, c array<double>")
    # a partial count is 2 ** GRAM_BITS numbers for each language and task; they are added up by gram
    summed = parts.select("lang", F.posexplode("c").alias("gram", "x")).where("x > 0").groupBy("lang", "gram").agg(F.sum("x").alias("x"))
    counts = np.zeros((len(languages), size))
    table = summed.toPandas()  # at most languages x 2 ** GRAM_BITS rows
    counts[table["lang"].map(number), table["gram"]] = table["x"]
    rate = (counts + 1e-4) / (counts + 1e-4).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights, bias, gap = [], [], []
    for bit in code.T:
        yes, no = rate[bit > 0], rate[bit < 0]
        if not len(yes) or not len(no):
            weights.append(np.zeros(size))
            bias.append(0.0)
            gap.append(1.0)
            continue
        w = np.clip(np.log(yes.mean(axis=0)) - np.log(no.mean(axis=0)), -4, 4)
        mean = rate @ w  # the margin a typical text of each language gets
        low, high = mean[bit > 0].min(), mean[bit < 0].max()
        weights.append(w)
        bias.append((low + high) / 2)
        gap.append(max(low - high, 0.01))
    trust = np.array(gap) / np.sum(gap)
    return Model(languages, code, np.array(weights, np.float32), np.array(bias), trust)


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score and ambiguous; the text is sent to Python once, kept or not."""
    at = keep.index(text) if text in keep else len(keep)

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, unsure = [], [], []
            for _, texts in text_slices(b.column(at)):
                if model is None:
                    lang += ["und"] * len(texts)
                    score += [0.0] * len(texts)
                    unsure += [False] * len(texts)
                    continue
                best, sure, close = model.decode(model.margins(texts))
                has = [bool(_LETTER.search(t)) for t in texts.to_pylist()]
                lang += [model.languages[i] if h else "und" for i, h in zip(best, has, strict=True)]
                score += [float(s) if h else 0.0 for s, h in zip(sure, has, strict=True)]
                unsure += [bool(c) and h for c, h in zip(close, has, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(keep))], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                schema=pa.schema([*[b.schema.field(i) for i in range(len(keep))], pa.field("lang_pred", pa.string()),
                                  pa.field("score", pa.float64()), pa.field("ambiguous", pa.bool_())]))

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col(text).alias("__text")] * (at == len(keep)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:len(keep)])
    return chosen.mapInArrow(batch, (fields + ", " if fields else "") + "lang_pred string, score double, ambiguous boolean")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every row, by a model fitted on ``docs``."""
    with_fold = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(with_fold, fit(docs), ["doc_id", "held_out"])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(read_table(spark, sf_dir, "documents"))
