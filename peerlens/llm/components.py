"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.llm.common import durable


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) with the smallest v of each u, and u itself, joined back.

    The minimum is pre-aggregated before its shuffle; both sides of the join are plain exchanges, so
    adaptive execution can split a node that has very many edges."""
    least = durable(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return pairs.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    tied = _star(down)
    ends = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
    return ends.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node but the roots; root is the smallest node it can reach.

    ``edges`` has two columns of one integer type. Rounds go on until the edges no longer change; each
    round writes its edges, so no lineage grows and a lost executor costs one stage."""
    now = durable(edges.toDF("u", "v").where("u <> v").distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        now = durable(_small(durable(_large(now).distinct())))
