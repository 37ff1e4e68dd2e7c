"""The pipeline on planted documents: what each stage takes out, and that the rest arrives whole."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

LETTERS = {"en": "aeilmnrst", "de": "ouklmßüdg"}


def _text(rng, lang, words):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(3, 8))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("corpus")
    rows = []
    for i in range(260):
        lang = rng.choice(list(LETTERS))
        rows.append([i, _text(rng, lang, rng.choice([12, 60, 150])), lang])
    toxic = {i for i in range(0, 260, 6)}
    for i in toxic:
        w = rows[i][1].split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["zilch", "zork"]))
        rows[i][1] = " ".join(w)
    base = _text(rng, "en", 200).split()
    for k in range(6):  # near copies: one word of 200 differs
        copy = list(base)
        copy[20 * k] = "changed"
        rows.append([300 + k, " ".join(copy), "en"])
    rows += [[310, " ".join(base).upper(), "en"], [311, " ".join(base), None], [311, " ".join(base), None]]
    passage = _text(rng, "de", 50)
    rows += [[320, _text(rng, "de", 80) + " " + passage, "de"], [321, passage + " " + _text(rng, "de", 90), "de"]]
    rows += [[330, None, "en"], [331, "1234 !!", "en"], [332, "", None], [None, _text(rng, "en", 40), "en"]]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": pa.array([r[2] for r in rows], pa.string()),
                      "source": ["s"] * len(rows), "n_chars": pa.array([len(r[1]) if r[1] else 0 for r in rows], pa.int64())})
    pq.write_table(table, folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(260), pa.int64()), "quality": pa.array([1] * 260, pa.int32()),
                             "toxic": pa.array([int(i in toxic) for i in range(260)], pa.int32())}), folder / "labels.parquet")
    return str(folder), rows, toxic, passage, base


def test_stages(spark, corpus):
    folder, rows, toxic, passage, base = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, folder), name)
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        seen[name] = out
        docs = out
    ids = {name: sorted(r.doc_id if r.doc_id is not None else -1 for r in df.select("doc_id").collect()) for name, df in seen.items()}
    every = sorted(r[0] if r[0] is not None else -1 for r in rows)
    assert ids["language_id"] == [i for i in every if i not in (330, 331, 332)]
    assert ids["toxicity"] == [i for i in ids["language_id"] if i not in toxic]
    assert ids["jaccard_join"] == sorted(i for i in set(ids["toxicity"]) if not 300 < i < 320)
    assert ids["substring_dedup"] == ids["jaccard_join"]
    cut = {r.doc_id: r for r in seen["substring_dedup"].collect()}
    before = {r[0]: r[1] for r in rows}
    assert cut[320].text == before[320][:-len(passage) - 1] and cut[321].text == before[321][len(passage) + 1:]
    assert cut[320].n_chars == len(cut[320].text)
    assert all(cut[i].text == before[i] for i in ids["jaccard_join"] if i not in (-1, 320, 321))
    assert sorted(set(ids["best_fit_packing"])) == ids["substring_dedup"]


def test_run(spark, corpus):
    folder, rows, toxic, _, _ = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == {r[0] for r in rows if r[0] not in toxic and r[0] not in (330, 331, 332) and not 300 < (r[0] or 0) < 320}
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_with_clashing_columns(spark, corpus):
    """Columns named like the stages' own keep their values."""
    folder, _, _, _, _ = corpus
    names = ["score", "predicted", "lang_pred", "ambiguous", "__h", "__n", "__id", "__key", "__class", "__kept", "__text", "h", "class"]
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    docs = plain.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, alone = stage(spark, docs, folder), stage(spark, plain, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in alone.select("doc_id").collect())
        assert all(r[n] == f"{n} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for n in names), name
