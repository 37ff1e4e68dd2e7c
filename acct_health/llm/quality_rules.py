"""Quality rules: base counts, and divergence from the language's usual distributions. Spark functions only.

Each text has two histograms: its characters by class (lower-case and other letters, upper case,
digits, punctuation, other), and its words over the common words of a language (all others as one).
Both are compared with a language's reference, which is the same histogram summed over all texts of
that language, by Jensen-Shannon distance (base 2, so 0 to 1). The verdict takes the language that is
nearest by words. A histogram is compared only if the text has enough characters or words for it. A
text is kept if its base counts pass and it is not far: by its characters alone, or less far by
characters and words both.

All counts of a text are made within its row, by array functions: repeated three-word windows are
found by sorting their 64-bit hashes. Only the references need a shuffle, of one small row for each
language and task. Features are stored once, so the text is read once.

Defined results: a null text counts as empty (all counts 0, base_failed, not kept); texts without a
language or of one without listed common words are no part of a reference, but are compared with all;
without any reference a text is kept unless base_failed. Rows with equal ids are judged each by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acct_health.llm.common import read_table, stored

LEAST_WORDS = 50
#: Histograms of fewer characters or words are not compared.
LEAST_CHARACTERS = 200
LEAST_COMPARED_WORDS = 100
#: A text is far from its language if its characters alone are beyond the first limit, or characters
#: and words both beyond the others.
CHARACTER_LIMIT = 0.26
BOTH_LIMITS = 0.16, 0.25

# Fixed lists of common words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on", "are", "with", "as", "be", "by", "this", "from", "or"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "avec", "pas"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"],
}
#: From so many words on, windows are told apart by all 64 bits of their hash (below, by 50 at least).
LONG_TEXT = 1 << 14
CLASSES = ["lower", "upper", "digit", "punct", "other"]
_BLANK = r"[\x20\x09-\x0D]+"


def _size(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)).cast("long")


def _left(text: Column, keep: str) -> Column:
    """Number of characters of a class: what is left without the others."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def features(docs: DataFrame, words_by_language: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """(doc_id, lang, base counts, class counts, common): ``common`` counts the listed words that occur."""
    listed = sorted({w for words in words_by_language.values() for w in words})
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.filter(F.split("t", _BLANK), lambda x: x != ""))
    rows = rows.withColumn("n_words", _size(F.col("w")))
    # words i, i + 1, i + 2 as one hash; the low bits of its place replace the hash's low bits. Texts of LONG_TEXT
    # words or more, where that would leave too few bits, sort pairs of the whole hash and the place instead.
    short = F.col("n_words") < LONG_TEXT
    rows = rows.withColumn("bits", F.length(F.conv(F.col("n_words").cast("string"), 10, 2)))
    rows = rows.withColumn("low", (F.pow(F.lit(2.0), F.col("bits")) - 1).cast("long"))
    firsts = F.slice("w", F.lit(1), F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int"))
    hashed = lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))
    rows = rows.withColumn("s", F.when(short, F.sort_array(F.transform(firsts, lambda x, i: hashed(x, i).bitwiseAND(
        F.bitwise_not("low")).bitwiseOR(i.cast("long"))))))
    rows = rows.withColumn("z", F.when(~short, F.sort_array(F.transform(firsts, lambda x, i: F.struct(
        hashed(x, i).alias("h"), i.cast("long").alias("at"))))))
    # sorted, equal windows are neighbours
    window = lambda x: F.call_function("shiftright", x, F.col("bits"))
    same = F.filter("s", lambda x, i: (window(x) == window(F.get("s", i + 1))) | (window(x) == window(F.get("s", i - 1))))
    alike = F.filter("z", lambda x, i: (x["h"] == F.get("z", i + 1)["h"]) | (x["h"] == F.get("z", i - 1)["h"]))
    rows = rows.withColumn("p", F.when(short, F.sort_array(F.transform(same, lambda x: x.bitwiseAND(F.col("low"))))).otherwise(
        F.sort_array(F.transform(alike, lambda x: x["at"]))))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    found = F.sort_array(F.filter("w", lambda x: x.isin(listed)))
    rows = rows.withColumn("c", found)
    # places in the sorted words where another word begins, and their distances
    change = F.transform("c", lambda x, i: F.when(x.eqNullSafe(F.get("c", i - 1)), F.lit(-1)).otherwise(i))
    rows = rows.withColumn("f", F.filter(change, lambda i: i >= 0))
    common = F.transform("f", lambda i, j: F.struct(F.get("c", i).alias("word"), (
        F.coalesce(F.get("f", j + 1), F.size("c")) - i).cast("long").alias("n")))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return rows.select(
        "doc_id", "lang", "n_words", F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _left(F.col("t"), "#*$%&|<>").alias("n_symbols"), (_size(F.col("lines")) - _size(F.array_distinct("lines"))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        _left(F.col("t"), r"\p{L}").alias("letters"), _left(F.col("t"), r"\p{Lu}").alias("upper"),
        _left(F.col("t"), "0-9").alias("digit"), _left(F.col("t"), r"\p{P}").alias("punct"), common.alias("common"))


def references(found: DataFrame, words_by_language: dict[str, list[str]] = COMMON_WORDS) -> dict[str, tuple[list[float], list[float]]]:
    """Class shares and word shares (the last: all other words) of each listed language, over all its texts."""
    own = found.where(F.col("lang").isin(list(words_by_language)))
    other = F.col("word_chars") - F.col("letters") - F.col("digit") - F.col("punct")
    sums = {r.lang: r for r in own.groupBy("lang").agg(
        F.sum("n_words").alias("words"), F.sum(F.col("letters") - F.col("upper")).alias("lower"), F.sum("upper").alias("upper"),
        F.sum("digit").alias("digit"), F.sum("punct").alias("punct"), F.sum(other).alias("other")).collect()}  # a row a language
    counts = {(r.lang, r.word): r.n for r in own.select("lang", F.explode("common").alias("x")).groupBy(
        "lang", F.col("x.word").alias("word")).agg(F.sum("x.n").alias("n")).collect()}  # listed words by language
    out = {}
    for lang, words in words_by_language.items():
        if lang in sums and sums[lang].words:
            row = sums[lang]
            total = max(1, sum(row[c] for c in CLASSES))
            n = [counts.get((lang, w), 0) for w in words]
            out[lang] = [row[c] / total for c in CLASSES], [x / row.words for x in n] + [(row.words - sum(n)) / row.words]
    return out


def _distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of shares from fixed ones."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def both(x: Column, q: Column) -> Column:
        m = (x + q) / 2
        return (part(x, m) + part(q, m)) / 2

    terms = F.transform(F.arrays_zip(shares.alias("p"), F.array(*[F.lit(float(q)) for q in reference]).alias("q")), lambda z: both(z["p"], z["q"]))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def judged(docs: DataFrame, words_by_language: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the distances character_js and word_js."""
    found = stored(features(docs, words_by_language), "features")
    known = references(found, words_by_language)
    lower = F.col("letters") - F.col("upper")
    other = F.greatest(F.col("word_chars") - F.col("letters") - F.col("digit") - F.col("punct"), F.lit(0))
    classes = [lower, F.col("upper"), F.col("digit"), F.col("punct"), other]
    total = F.greatest(sum(classes[1:], classes[0]), F.lit(1))
    shares = F.array(*[c / total for c in classes])
    rows = found.withColumn("counts", F.map_from_entries("common"))
    options = []
    for lang, (character, words) in known.items():
        n = F.transform(F.array(*[F.lit(w) for w in words_by_language[lang]]), lambda w: F.coalesce(F.try_element_at("counts", w), F.lit(0)).cast("long"))
        rest = F.col("n_words") - F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
        share = F.transform(F.concat(n, F.array(rest)), lambda x: x / F.greatest("n_words", F.lit(1)))
        options.append(F.struct(_distance(share, words).alias("word_js"), _distance(shares, character).alias("character_js")))
    nearest = F.array_min(F.array(*options)) if options else F.lit(None).cast("struct<word_js:double,character_js:double>")
    rows = rows.withColumn("near", nearest)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    character, word = F.col("near.character_js"), F.col("near.word_js")
    far = (F.col("word_chars") >= LEAST_CHARACTERS) & ((character > CHARACTER_LIMIT) | (
        (F.col("n_words") >= LEAST_COMPARED_WORDS) & (character > BOTH_LIMITS[0]) & (word > BOTH_LIMITS[1])))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"), "near.character_js", "near.word_js")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "documents")).drop("character_js", "word_js")


_LISTED = ", ".join(f"('{lang}', '{word}')" for lang, words in COMMON_WORDS.items() for word in words)
ORACLE_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT r, doc_id, lang, ws, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(t, '[^\pL]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS upper,
    length(regexp_replace(t, '[^0-9]', '', 'g')) AS digit, length(regexp_replace(t, '[^\pP]', '', 'g')) AS punct FROM w),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS q
    FROM (SELECT r, ws, unnest(range(1, n_words - 1)) AS i FROM f WHERE n_words >= 3)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, q) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) v(k) GROUP BY r),
listed(l, word) AS (VALUES {_LISTED}),
wc AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(ws) AS word FROM f) GROUP BY ALL),
sums AS (SELECT lang AS l, sum(n_words) AS words, sum(letters - upper) AS c1, sum(upper) AS c2, sum(digit) AS c3, sum(punct) AS c4,
    sum(word_chars - letters - digit - punct) AS c5 FROM f WHERE lang IN (SELECT l FROM listed) GROUP BY lang HAVING sum(n_words) > 0),
refc AS (SELECT l, c, x / greatest(1, c1 + c2 + c3 + c4 + c5) AS q
    FROM (SELECT *, unnest([c1, c2, c3, c4, c5]) AS x, unnest([1, 2, 3, 4, 5]) AS c FROM sums)),
refn AS (SELECT s.l, t.word, coalesce(sum(wc.n), 0) AS n FROM sums s JOIN listed t USING (l) LEFT JOIN (wc JOIN f ON f.r = wc.r)
    ON wc.word = t.word AND f.lang = s.l GROUP BY ALL),
refw AS (SELECT l, word, n / words AS q FROM refn JOIN sums USING (l)
    UNION ALL SELECT l, NULL, (any_value(words) - sum(n)) / any_value(words) FROM refn JOIN sums USING (l) GROUP BY l),
docn AS (SELECT f.r, refw.l, refw.word, refw.q, coalesce(wc.n, 0) AS n, f.n_words FROM f, refw LEFT JOIN wc ON wc.r = f.r AND wc.word = refw.word),
docw AS (SELECT r, l, q, CASE WHEN word IS NULL THEN n_words - sum(n) OVER (PARTITION BY r, l) ELSE n END / greatest(n_words, 1) AS p FROM docn),
docc AS (SELECT r, l, q, x / greatest(1, list_sum(xs)) AS p FROM (
    SELECT r, unnest(xs) AS x, xs, unnest([1, 2, 3, 4, 5]) AS c FROM (
        SELECT r, [letters - upper, upper, digit, punct, greatest(word_chars - letters - digit - punct, 0)] AS xs FROM f)) JOIN refc USING (c)),
js AS (SELECT kind, r, l, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0)) AS js
    FROM (SELECT 'w' AS kind, * FROM docw UNION ALL SELECT 'c', * FROM docc) GROUP BY kind, r, l),
near AS (SELECT r, min({{'w': a.js, 'c': b.js}}) AS x FROM (SELECT * FROM js WHERE kind = 'w') a JOIN (SELECT * FROM js WHERE kind = 'c') b USING (r, l) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, failed AS base_failed,
    NOT failed AND NOT coalesce(word_chars >= {LEAST_CHARACTERS} AND (x.c > {CHARACTER_LIMIT}
        OR (n_words >= {LEAST_COMPARED_WORDS} AND x.c > {BOTH_LIMITS[0]} AND x.w > {BOTH_LIMITS[1]})), false) AS kept
FROM (SELECT f.*, n_repeat_words, x, n_words < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS failed
      FROM f LEFT JOIN cov USING (r) LEFT JOIN near USING (r))
"""
