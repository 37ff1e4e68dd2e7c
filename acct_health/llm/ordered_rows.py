"""Rows of conversations in their order: short conversations whole, long ones as segments.

Conversations of at most ``long_rows`` rows are sorted within one task each. A longer one is never
brought together: equal rows are counted before any shuffle, all rows are range-partitioned by
(conversation, turn, row mark, copy), and each range is cut into segments of bounded rows and bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acct_health.llm.common import stored

#: Rows of a conversation that one task may hold at a time, and bytes of a segment's texts.
LONG_ROWS = 4096
SEGMENT_BYTES = 2 << 20
_COPIES = 4096

SEGMENT = ("conv_id long, part int, segment long, turns array<long>, roles array<string>, texts array<string>, "
           "repeats array<boolean>")
PLACE = ["conv_id", "part", "segment"]


def row_mark(role: Column, text: Column) -> Column:
    """SHA-256 of a row's role and text: tells rows apart, and orders rows of one turn."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit(":"), text), 256))


def sizes(rows: DataFrame) -> DataFrame:
    """(conv_id, n): rows of every conversation, counted with their ``copies``."""
    return stored(rows.groupBy("conv_id").agg(F.sum("copies").alias("n")), "sizes")


def split(rows: DataFrame, counted: DataFrame, long_rows: int = LONG_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of short conversations, rows of long ones), the second None if there is none."""
    long = counted.where(F.col("n") > long_rows).select(F.col("conv_id").alias("__long"))
    if long.isEmpty():
        return rows, None
    same = rows["conv_id"].eqNullSafe(long["__long"])
    return rows.join(long, same, "left_anti"), rows.join(long, same, "left_semi")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of a conversation in one task, one after the other, by turn (null first), then mark."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "mark")


def long_segments(rows: DataFrame, n_rows: int, segment_rows: int = LONG_ROWS) -> DataFrame:
    """Long conversations as rows of ``SEGMENT``; (part, segment) orders those of one conversation.

    ``rows`` has conv_id, turn, role, text, mark and copies; ``repeats`` is true where role and text came
    earlier in the conversation."""
    alike = rows.groupBy("conv_id", "turn", "mark").agg(F.sum("copies").alias("n"), F.first("role").alias("role"),
                                                        F.first("text").alias("text")).where("n > 0")
    alike = stored(alike, "alike")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = alike.groupBy("conv_id", "mark").agg(F.min(order).alias("first")) \
                  .select(F.col("conv_id").alias("__conv"), F.col("mark").alias("__mark"), "first")
    flagged = alike.join(firsts, alike["conv_id"].eqNullSafe(firsts["__conv"]) & (alike["mark"] == firsts["__mark"])) \
                   .withColumn("again", order > F.col("first"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _COPIES)))
    copy = F.explode(F.sequence(F.col("block") * _COPIES, F.least(F.col("n"), (F.col("block") + 1) * _COPIES) - 1))
    each = flagged.withColumn("block", block).withColumn("copy", copy)
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "mark", "copy"]
    parts = max(1, -(-n_rows // (4 * segment_rows)))
    ranged = each.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    cut = ranged.select("conv_id", F.spark_partition_id().alias("part"), "turn", "role", "text",
                        (F.col("again") | (F.col("copy") > 0)).alias("repeats"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, size, number = None, [], 0, 0

        def row():
            turns, roles, texts, repeats = zip(*held, strict=True)
            return pa.RecordBatch.from_pylist([{
                "conv_id": conv, "part": part, "segment": number, "turns": list(turns), "roles": list(roles),
                "texts": list(texts), "repeats": list(repeats)}], _SCHEMA)

        for b in batches:
            for c, part, *r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if held and (c != conv or len(held) >= segment_rows or size >= SEGMENT_BYTES):
                    yield row()
                    held, size, number = [], 0, number + 1
                conv = c
                held.append(r)
                size += len(r[1]) + len(r[2])
        if held:
            yield row()

    return stored(cut.mapInArrow(segments, SEGMENT), "segments")


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int64()),
                     ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
                     ("texts", pa.list_(pa.string())), ("repeats", pa.list_(pa.bool_()))])
