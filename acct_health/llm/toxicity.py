"""Toxicity by a weighted finite-state grammar over clauses.

Words pass through small transducers into classes: insult (terms learnt from labelled rows, as whole
words or as word beginnings), threat, target, negation, reported speech. Composed, they read a clause
from left to right; each insult or threat that is matched leaves by a path that says whether a target
was read in the clause, whether it is negated and whether it is reported. A threat is only matched
where its clause has a target. A clause scores its strongest match: the term's log odds plus the
path's weight; by a negated or reported path a term counts ``CALM`` at most, so that such a match is
clean whatever the term, unless labelled rows with no other matches say otherwise. A text's score is
the probability that its strongest clause gives, or that of unmatched texts; words outside a matched
clause count nothing.

Terms, threats and path weights are learnt from at most ``TRAIN_ROWS`` labelled rows (by a hash of
their id) with crc32(doc_id) % 4 <> 2. Each threat word has log odds of its own, from the texts that
have it with a target (``THREAT`` without any), so one that is an ordinary word of another language
loses its weight there. A term needs enough toxic texts with contexts of their own that chance
would not give a single one among all candidates, so words of a toxic text with many copies don't
become terms. Lists of function words are fixed; a score uses the text only.

Defined results: a null or empty text and one without a match get the base score. Without usable
labels nothing is learnt, and only threats can match. A null id is never learnt from. Rows with equal
ids are judged each by itself; an id labelled both ways counts as toxic.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acct_health.llm.common import hash_share, read_table
from acct_health.llm.language_id import held_out
from acct_health.llm.wordcache import text_slices

TRAIN_ROWS = 20_000
#: Lengths of word beginnings tried as terms.
STEMS = (4, 5, 6, 7)
#: Share of toxic texts among those with it that a word, and a word beginning, needs.
PRECISION, STEM_PRECISION = 0.85, 0.96
THRESHOLD = 0.3
#: Log odds of a threat before its path's weight, where no labelled text has it.
THREAT = 1.0
#: Log odds that a term has at most by a negated or reported path, before the path's weight. With any
#: path's weight before learning it gives less than ``THRESHOLD``.
CALM = -1.6
#: Words before a match in which a negation is its own.
NEGATION_REACH = 3
#: Path weights (log odds added) before learning; learnt ones are drawn from these by ``PATH_PRIOR`` matches.
PATH_PRIOR = 20
NEGATED, REPORTED, TARGETED = -0.7, -0.4, 0.7

# Fixed word lists of the transducers.
THREATS = frozenset("kill murder stab shoot strangle töten umbringen erschießen tuer assassiner poignarder matar asesinar apuñalar".split())
TARGETS = frozenset("you your yours he she him her they them du dich dir ihr euch tu toi vous tú usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never none cannot nicht kein keine nie pas jamais aucun nunca ningún".split())
REPORTS = frozenset("said says say wrote writes called quoted claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())

_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_QUOTES = tuple("\"“«„")
_QUOTE_END = re.compile(r"[\"”»“]\W*$")
_CLAUSE_END = re.compile(r"[.!?;:]$")


def _plain(word: str) -> str:
    return _EDGE.sub("", word).lower()


@dataclass(frozen=True)
class Grammar:
    terms: dict[str, float] = field(default_factory=dict)  # a word, or a beginning with *
    paths: dict[tuple[bool, bool, bool], float] = field(default_factory=dict)  # targeted, negated, reported
    base: float = 0.02
    threats: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float | None:
        """The insult and threat transducers: a whole word first, else its longest known beginning; None is no match."""
        plain = _plain(word)
        if plain in THREATS:
            return self.threats.get(plain, THREAT)
        if plain in self.terms:
            return self.terms[plain]
        for n in reversed(STEMS):
            if len(plain) > n and plain[:n] + "*" in self.terms:
                return self.terms[plain[:n] + "*"]
        return None

    def log_odds(self, weight: float, path: tuple[bool, bool, bool]) -> float:
        return (min(weight, CALM) if _calm(path) else weight) + self.path_weight(path)

    def path_weight(self, path: tuple[bool, bool, bool]) -> float:
        prior = TARGETED * path[0] + NEGATED * path[1] + REPORTED * path[2]
        return self.paths.get(path, prior)

    def score(self, matches: list[tuple[float, tuple[bool, bool, bool]]]) -> float:
        if not matches:
            return self.base
        best = max(self.log_odds(w, p) for w, p in matches)
        return max(self.base, 1 / (1 + math.exp(-best)))


def _calm(path: tuple[bool, bool, bool]) -> bool:
    return path[1] or path[2]


def matches(texts: pa.Array, grammar: Grammar) -> list[list[tuple[float, tuple[bool, bool, bool]]]]:
    """Each text's matches: the term's weight and the path it left the automaton by."""
    return [[(w, p) for _, w, p in found] for found in _matches(texts, grammar)]


def _matches(texts: pa.Array, grammar: Grammar) -> list[list[tuple[str, float, tuple[bool, bool, bool]]]]:
    """Each text's matches: the word, its weight and its path (targeted, negated, reported). The composed
    automaton reads whole clauses: targets anywhere in the match's clause, before the match the reports,
    open quotation marks (one at the match itself unless it opens the clause) and near negations."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    out: list[list] = [[] for _ in range(len(texts))]
    if not len(words):
        return out
    forms = words.dictionary.to_pylist()
    weight = [grammar.weight(w) for w in forms]
    matched = np.fromiter((w is not None for w in weight), bool, len(forms))
    code = words.indices.to_numpy()
    places = np.flatnonzero(matched[code])
    if not len(places):
        return out
    size = pc.list_value_length(split).to_numpy()
    ends = np.cumsum(size)
    rows = np.searchsorted(ends, places, side="right")
    hit = np.zeros(len(size), bool)
    hit[rows] = True
    used = np.unique(code[np.repeat(hit, size)])  # forms of texts with matches; clauses don't leave a text
    some = [forms[i] for i in used.tolist()]
    plain = dict(zip(used.tolist(), map(_plain, some), strict=True))

    def flag(is_it: Iterator[bool]) -> np.ndarray:
        """A property of each word, in texts with matches."""
        of_form = np.zeros(len(forms), bool)
        of_form[used] = np.fromiter(is_it, bool, len(used))
        return of_form[code]

    def before(is_it: Iterator[bool]) -> np.ndarray:
        """The number of words with a property before each place."""
        return np.concatenate([[0], np.cumsum(flag(is_it))])

    targets, negations, reports = (before(w in listed for w in plain.values()) for listed in (TARGETS, NEGATIONS, REPORTS))
    opening = flag(w[:1] in _QUOTES for w in some)
    number = np.arange(len(code))
    opened = np.maximum.accumulate(np.where(opening, number, -1))  # last opening mark up to here
    closed = np.maximum.accumulate(np.where(flag(bool(_QUOTE_END.search(w)) for w in some), number, -1))
    last_word = flag(bool(_CLAUSE_END.search(w)) for w in some)
    last_word[ends[ends > 0] - 1] = True
    clause_ends = np.flatnonzero(last_word)
    clauses = np.searchsorted(clause_ends, places)
    for at, row, clause in zip(places.tolist(), rows.tolist(), clauses.tolist(), strict=True):
        a = int(clause_ends[clause - 1]) + 1 if clause else 0
        b = int(clause_ends[clause]) + 1
        targeted = bool(targets[b] > targets[a])
        form = int(code[at])
        if plain[form] in THREATS and not targeted:
            continue
        negated = bool(negations[at] > negations[max(a, at - NEGATION_REACH)])
        quoted = at > a and (opening[at] or opened[at - 1] >= a and closed[at - 1] < opened[at - 1])
        out[row].append((plain[form], float(weight[form]), (targeted, negated, bool(quoted or reports[at] > reports[a]))))
    return out


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(toxic, text) of at most about ``rows`` labelled rows that are not held out."""
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = usable.count()
    picked = usable.where(hash_share("doc_id", 9, rows / max(1, total)))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(
        (F.col("toxic") > 0).alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Grammar:
    sample = labelled(docs, labels, rows).persist()
    try:
        return _fit(sample)
    finally:
        sample.unpersist()


def _fit(sample: DataFrame) -> Grammar:
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(True, 0), size.get(False, 0)
    if not toxic or not clean:
        return Grammar()
    words = F.filter(F.transform(F.split("text", r"[ \t-\r]+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))),
                     lambda w: w != "")
    with_words = sample.select("toxic", F.xxhash64("text").alias("doc"), words.alias("w"))

    def keys(word):
        stems = [F.when(F.length(word) > n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in STEMS]
        return F.filter(F.array(word, *stems), lambda k: k.isNotNull())

    near = F.transform("w", lambda x, i: F.struct(x.alias("word"), F.xxhash64(
        F.get("w", i - 1), F.get("w", i + 1)).alias("near")))
    seen = with_words.where("toxic").select("doc", F.explode(near).alias("x")).select(
        "doc", F.explode(keys(F.col("x.word"))).alias("key"), F.col("x.near").alias("near"))
    # texts that bring a context of their own: copies of a text don't
    contexts = seen.groupBy("key").agg(F.least(F.countDistinct("doc"), F.countDistinct("near")).alias("yes")).where("yes >= 4")
    other = with_words.where("not toxic").select(F.explode(F.array_distinct(F.flatten(F.transform("w", keys)))).alias("key"))
    both = contexts.join(other.join(contexts, "key", "left_semi").groupBy("key").agg(F.count("*").alias("no")), "key", "left").fillna(0, ["no"])
    share = toxic / (toxic + clean)
    both = both.withColumn("n", F.col("yes") + F.col("no")).withColumn("p", F.col("yes") / F.col("n")).where(
        F.col("p") >= F.when(F.endswith("key", F.lit("*")), F.lit(max(STEM_PRECISION, share))).otherwise(F.lit(max(PRECISION, share))))
    rest = F.when(F.col("p") < 1, (1 - F.col("p")) * F.log((1 - F.col("p")) / (1 - share))).otherwise(0.0)
    gain = F.col("n") * (F.col("p") * F.log(F.col("p") / share) + rest)  # Chernoff's exponent against chance
    chance = math.log(max(2, contexts.count())) + 2
    found = both.where(gain >= chance).collect()  # terms of the bounded sample
    terms = {r.key: math.log((r.yes + 0.5) / (r.no + 0.5)) for r in found if r.key not in THREATS}
    draft = Grammar(terms)

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, doc = b.column("toxic").to_pylist(), b.column("doc").to_pylist()
            for row, texts in text_slices(b.column("text")):
                rows = [(label[row + i], doc[row + i], key) for i, m in enumerate(_matches(texts, draft)) for key in _uses(m)]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in rows], pa.bool_()), pa.array([d for _, d, _ in rows], pa.int64()),
                                                  pa.array([k for _, _, k in rows], pa.string())], ["toxic", "doc", "key"])

    used = sample.select("toxic", F.xxhash64("text").alias("doc"), "text").mapInArrow(uses, "toxic boolean, doc long, key string").groupBy(
        "key", "toxic").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("texts")).collect()  # two rows a path and threat at most
    table, texts = {(r.key, r.toxic): r.n for r in used}, {(r.key, r.toxic): r.texts for r in used}
    every = [tuple(bool(p & bit) for bit in (4, 2, 1)) for p in range(8)]
    yes, no = (sum(table.get((str(p), t), 0) for p in every if not _calm(p)) for t in (True, False))
    weights = {}
    for path in every:
        y, n = table.get((str(path), True), 0), table.get((str(path), False), 0)
        learnt = math.log((y + 0.5) / (n + 0.5)) - (CALM if _calm(path) else math.log((yes + 0.5) / (no + 0.5)))
        weights[path] = (PATH_PRIOR * draft.path_weight(path) + (y + n) * learnt) / (PATH_PRIOR + y + n)
    # texts count on a path with a target, so its weight goes off again; without texts this is THREAT
    threats = {w: math.log((texts.get((w, True), 0) + 0.5 * math.exp(THREAT + TARGETED)) / (texts.get((w, False), 0) + 0.5)) - TARGETED
               for w in sorted(THREATS) if (w, True) in texts or (w, False) in texts}
    none = table.get(("", True), 0), table.get(("", False), 0)
    return Grammar(terms, weights, min(0.29, (none[0] + 0.5) / (sum(none) + 1)), threats)


def _uses(found: list[tuple[str, float, tuple[bool, bool, bool]]]) -> list[str]:
    """What a labelled text teaches about: the paths of its terms (negated and reported ones if it has no
    others, else its label says nothing of them), and threats that count; nothing matched is ''."""
    if not found:
        return [""]
    threats = {w for w, _, p in found if w in THREATS and not _calm(p)}
    paths = {p for w, _, p in found if w not in THREATS or _calm(p)}
    calm = {p for p in paths if _calm(p)}
    return sorted({str(p) for p in (paths - calm or (set() if threats else calm))} | threats)


def predict(docs: DataFrame, grammar: Grammar, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with score and predicted; the text is sent to Python once, kept or not."""
    at = keep.index(text) if text in keep else len(keep)

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [grammar.score(m) for _, texts in text_slices(b.column(at)) for m in matches(texts, grammar)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(keep))], pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32())],
                schema=pa.schema([*[b.schema.field(i) for i in range(len(keep))], pa.field("score", pa.float64()), pa.field("predicted", pa.int32())]))

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col(text).alias("__text")] * (at == len(keep)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:len(keep)])
    return chosen.mapInArrow(batch, (fields + ", " if fields else "") + "score double, predicted int")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, by a grammar learnt from ``labels``."""
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), fit(docs, labels), ["doc_id", "held_out"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
