"""Connected components of an edge table, by alternating large-star and small-star steps in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acct_health.llm.common import stored


def _least(edges: DataFrame) -> DataFrame:
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    up = _least(both).where("v > u")
    return up.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    near = _least(edges)
    down = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every vertex that has an edge and is not its component's least, with that least one.

    ``edges`` has two orderable columns u and v of one type; direction, repeats and loops don't
    matter. Rows with a null are no edges. An empty table gives an empty one. Steps are stored in the
    shared folder and end when one changes nothing (at most about log² of the vertices)."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return now
        before = mark
        now = stored(_small_star(_large_star(now)), "edges")
