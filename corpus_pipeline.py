"""Five stages from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs; all but the last return the columns of documents. ``run`` applies them to the
documents table.

* language_id: a document without a recognisable language, or whose two nearest languages are too
  close to tell apart, goes.
* toxicity: a document predicted toxic goes.
* jaccard_join: of each group of linked documents the one with the smallest id stays (null ids last;
  of rows alike in id and text, one). Documents without words are no group and stay.
* substring_dedup: passages that occur more than once are cut out of the texts.
* best_fit_packing: what is left, as pieces with their place in a sequence.

Columns other than doc_id and text have numbers for names within a stage, so none of them can clash with a
stage's own, and have theirs again in its result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acct_health.llm import jaccard_join, language_id, packing, substring_dedup, toxicity
from acct_health.llm.blocks import text_hash
from acct_health.llm.common import read_table, stored

ORACLE_SQL = None  # trained models and tokenizers have no SQL form; tests hold the rows against brute force

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _own_names(stage: Stage, uses: tuple[str, ...] = ("doc_id", "text")) -> Stage:
    """The stage on ``docs`` with only the columns it uses under their names."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = [c if c in uses else f"column {i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*inner), sf_dir)
        return out.select(*[F.col(f"`{x}`").alias(c) for x, c in zip(inner, docs.columns, strict=True)])

    return run_stage


def _keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.predict(docs, language_id.fit(docs), docs.columns)
    return found.where("lang_pred <> 'und' and not ambiguous")


def _drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grammar = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, grammar, docs.columns).where("predicted = 0")


def _keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = stored(jaccard_join.jaccard_classes(docs), "classes").select(F.col("h").alias("__h"), F.col("class").alias("__class"))
    keys = docs.select("doc_id", text_hash(F.col("text")).alias("__h")).groupBy("__h", "doc_id").agg(F.count("*").alias("__n"))
    known = keys.join(classes, "__h")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "__h", "__n"))
    kept = known.where("__class is not null").groupBy("__class").agg(first.alias("x")).select("x.doc_id", "x.__h", "x.__n")
    kept = kept.unionByName(known.where("__class is null").select("doc_id", "__h", F.lit(1).cast("long").alias("__n")))
    kept = stored(kept.withColumnRenamed("doc_id", "__id").withColumnRenamed("__h", "__key"), "kept")
    rows = docs.withColumn("__h", text_hash(F.col("text")))
    rows = rows.join(kept, (rows["__h"] == kept["__key"]) & rows["doc_id"].eqNullSafe(kept["__id"]))
    # only rows alike in id and text have to meet to leave one
    return rows.where("__n = 1").unionByName(rows.where("__n > 1").dropDuplicates(["__h", "doc_id"]))


def _cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(docs)


keep_identified = _own_names(_keep_identified, ("doc_id", "text", "lang"))
drop_toxic = _own_names(_drop_toxic)
keep_one_of_each_group = _own_names(_keep_one_of_each_group)
cut_repeated_passages = _own_names(_cut_repeated_passages, ("doc_id", "text", "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_identified),
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
