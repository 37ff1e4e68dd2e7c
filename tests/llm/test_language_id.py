"""Language identification: codes, held-out accuracy on invented languages, odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from acct_health.llm.language_id import codewords, fit, identified, predict

LETTERS = {"aa": "aeilmnrst", "bb": "ouklmßüdg", "cc": "çéèqavirn", "dd": "абвгдежзи"}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 20])
def test_codewords_are_apart(n):
    code = codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    if n > 1:
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2) and (abs(code.sum(0)) < n).all()


def _text(rng, lang, words):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(words)).capitalize() + "."


def _rows():
    rng = random.Random(12)
    rows = [(i, _text(rng, lang, rng.choice([3, 30, 200])), lang) for i, lang in enumerate(rng.choices(list(LETTERS), k=300))]
    return rows + [(None, _text(rng, "aa", 30), "aa"), (400, None, "bb"), (401, "", "bb"), (402, "123 456 !!", "cc"), (403, _text(rng, "cc", 20_000), None),
                   (404, _text(rng, "aa", 40), None), (404, _text(rng, "dd", 40), "zz")]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' as score", "'l' as lang_pred", "1 as held_out")


def test_held_out_accuracy(spark):
    rows = _rows()
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in identified(_frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    by_id = {d: (h, p, s) for d, h, p, s in got}
    for d, t, lang in rows[:300]:
        held, pred, score = by_id[d]
        assert held == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= score <= 1
    held = [(by_id[d][1], lang) for d, _, lang in rows[:300] if by_id[d][0]]
    assert len(held) > 40 and sum(p == l for p, l in held) >= 0.97 * len(held)
    assert [by_id[i][1:] for i in (400, 401, 402)] == [("und", 0.0)] * 3
    assert by_id[403][1] == "cc" and by_id[None][0] is False
    assert {p for d, _, p, _ in got if d == 404} == {"aa", "dd"}  # "zz" has too few rows to be learnt


def test_held_out_rows_teach_nothing(spark):
    rows = _rows()
    learnt = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    wrong = [(d, t, "bb") if d is None or zlib.crc32(str(d).encode()) % 4 == 2 else (d, t, lang) for d, t, lang in rows]
    a, b, c = (fit(_frame(spark, x)) for x in (rows, wrong, learnt))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.weights, c.weights)


def test_nothing_to_learn_and_mixed_text(spark):
    none = _frame(spark, [(1, "some words", None)])
    assert [(r.lang_pred, r.score) for r in identified(none).collect()] == [("und", 0.0)]
    assert identified(_frame(spark, _rows()).where("false")).count() == 0
    model = fit(_frame(spark, _rows()))
    rng = random.Random(1)
    _, sure, unsure = model.decode(model.margins(pa.array([_text(rng, "aa", 50)])))
    assert sure[0] > 0.99 and not unsure[0]
    _, sure, unsure = model.decode(np.zeros((1, model.code.shape[1])))  # no bit says anything
    assert sure[0] == pytest.approx(1 / len(model.languages)) and unsure[0]  # languages of a row or two are learnt too
    kept = predict(_frame(spark, _rows()), model, ["text", "lang"])
    assert kept.columns == ["text", "lang", "lang_pred", "score", "ambiguous"]


def test_shares_below_a_millionth_and_rare_languages(spark):
    from acct_health.llm.common import hash_share
    ids = spark.range(1 << 20)
    n = ids.where(hash_share("id", 5, 2.0 ** -12)).count()
    assert 150 < n < 370 and ids.where(hash_share("id", 5, 2.0 ** -40)).count() == 0 and ids.where(hash_share("id", 5, 1.5)).count() == 1 << 20
    plan = ids.where(hash_share("id", 5, 1e-12))._jdf.queryExecution().optimizedPlan().toString()
    assert str(int((1 << 62) * 1e-12)) in plan  # a small share is no zero
    rng = random.Random(3)
    rows = _rows()
    last = max(r[0] for r in rows if r[0] is not None)
    odd = next(i for i in range(last + 1, last + 50) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows.append((odd, "ψωμί και νερό για όλους " * 20, "el"))
    assert "el" in fit(_frame(spark, rows)).languages
