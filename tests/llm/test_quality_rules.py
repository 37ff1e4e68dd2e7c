"""Quality rules: counts and distances against plain Python, verdicts on planted texts."""

import math
import random
import re

import pytest

from acct_health.llm.quality_rules import BOTH_LIMITS, CHARACTER_LIMIT, COMMON_WORDS, features, judged, references

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def _clean(rng, n, lang="en"):
    return " ".join(rng.choice(COMMON_WORDS[lang]) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(n)) + "."


def _rows():
    rng = random.Random(6)
    rows = [(i, _clean(rng, rng.choice([60, 120, 300]), rng.choice(list(COMMON_WORDS))), "en") for i in range(30)]
    rows = [(i, t, next(l for l in COMMON_WORDS if sum(w in COMMON_WORDS[l] for w in t.split()) == max(
        sum(w in COMMON_WORDS[k] for w in t.split()) for k in COMMON_WORDS))) for i, t, _ in rows]
    odd = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\nx\n\nx \n y\ny", "#$%& <|> **", "é\u00a0é ñ 日本 🙂", "w " * 4000,
           "a b c d " * 30, " lead\x0b\x0c\rtail ", "| ".join(_clean(rng, 200).split()), _clean(rng, 200).upper() + " !!", "0123456789 " * 100]
    rows += [(100 + i, t, "xx" if i % 2 else None) for i, t in enumerate(odd)]
    return rows + [(None, "the of and", "xx"), (500, "the of and", "en"), (500, "the of and", "en")]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as n_words", "'c' as c", "2 as w", "3 as kept")


def test_counts(spark):
    rows = _rows()
    got = judged(_frame(spark, rows)).collect()
    key = lambda r: (r[0] if r[0] is not None else -1, *r[1:])
    want = sorted(key((d, *_counts(t))) for d, t, _ in rows)
    assert sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def _js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0)
    return math.sqrt(max(0, (kl(p) + kl(q)) / 2))


def test_distances(spark):
    rows = _rows()
    frame = _frame(spark, rows)
    known = references(features(frame))
    got = {r.doc_id: r for r in judged(frame).collect() if r.doc_id is not None}
    for d, t, _ in rows[:30]:
        w = WORD.findall(t)
        options = []
        for lang, (character, words) in known.items():
            n = [w.count(x) for x in COMMON_WORDS[lang]]
            share = [x / len(w) for x in [*n, len(w) - sum(n)]]
            joined = "".join(w)
            lower = sum(c.isalpha() and not c.isupper() for c in joined)
            classes = [lower, sum(c.isupper() for c in joined), sum(c.isdigit() for c in joined), joined.count(".")]
            classes.append(len(joined) - sum(classes))
            options.append((_js(share, words), _js([x / sum(classes) for x in classes], character)))
        assert (got[d].word_js, got[d].character_js) == pytest.approx(min(options), abs=1e-9)


def test_verdicts(spark):
    got = {r.doc_id: r for r in judged(_frame(spark, _rows())).collect()}
    assert [i for i in range(30) if not got[i].kept and not got[i].base_failed] == []
    shouted, digits = got[115], got[116]
    assert not shouted.kept and shouted.character_js > CHARACTER_LIMIT and not digits.kept
    assert BOTH_LIMITS[0] < CHARACTER_LIMIT


def test_no_reference_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    (r,) = judged(_frame(spark, [(1, text, None)])).collect()
    assert r.kept and r.word_js is None
    assert judged(_frame(spark, _rows()).where("false")).count() == 0


def test_windows_of_a_very_long_text(spark):
    """A million and a half words of which one window is repeated, at the ends (a local heap holds no more)."""
    n = 1_500_000
    text = spark.range(1).selectExpr("0L as doc_id", "'en' as lang", f"concat(array_join(transform(sequence(1, {n}), x -> cast(x as string)), ' '), ' 1 2 3') as text")
    assert [(r.n_words, r.n_repeat_words) for r in features(text).collect()] == [(n + 3, 6)]


def test_long_texts_count_like_short_ones(spark, monkeypatch):
    from acct_health.llm import quality_rules
    rng = random.Random(17)
    texts = [None, "", "a", "a a", "a a a a", *[" ".join(rng.choice("abcd") for _ in range(n)) for n in (5, 17, 60, 200)]]
    monkeypatch.setattr(quality_rules, "LONG_TEXT", 10)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.n_repeat_words for r in features(df).collect()} == {i: _counts(t)[4] for i, t in enumerate(texts)}
