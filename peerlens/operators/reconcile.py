"""Merging a fresh window into stored history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import weekdays_between


def adjustment_verdicts(old: DataFrame, new: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Per entity: keep, rescale by a constant, or refetch, from the overlap of stored and fresh closes."""
    o = old.where(F.col("close").isNotNull() & (F.col("close") != 0)).select("entity", "date", F.col("close").alias("o"))
    n = new.where(F.col("close").isNotNull()).select("entity", "date", F.col("close").alias("n"))
    j = o.join(n, ["entity", "date"]).withColumn("r", F.col("n") / F.col("o"))
    # the overlap is a few sessions per entity
    g = j.groupBy("entity").agg(
        F.percentile("r", F.lit(0.5)).alias("med"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("n")
    ).where(F.col("n") >= 2)
    spread = (F.col("hi") - F.col("lo")) / F.col("med")
    verdict = (
        F.when(F.col("med") <= 0, "refetch")
        .when(F.abs(F.col("med") - 1) <= tolerance, "keep")
        .when(spread <= tolerance, "rescale")
        .otherwise("refetch")
    )
    return g.select("entity", "med", verdict.alias("verdict"))


def rescale(old: DataFrame, verdicts: DataFrame) -> DataFrame:
    factor = verdicts.where(F.col("verdict") == "rescale").select("entity", F.col("med").alias("__f"))
    return old.join(factor, "entity", "left").withColumn("close", F.col("close") * F.coalesce("__f", F.lit(1.0))).drop("__f")


def combine_first(new: DataFrame, old: DataFrame, keys=("entity", "date"), values=("close", "volume")) -> DataFrame:
    """New values win cell by cell, old ones fill."""
    n = new.select(*keys, *[F.col(v).alias(f"__n_{v}") for v in values])
    j = old.select(*keys, *values).join(n, list(keys), "full_outer")
    return j.select(*keys, *[F.coalesce(f"__n_{v}", v).alias(v) for v in values])


def top_up(old: DataFrame, new: DataFrame, tolerance: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Stored history merged with a fresh window, and the verdicts; entities marked ``refetch`` must
    be loaded whole before their history is trusted."""
    verdicts = adjustment_verdicts(old, new, tolerance)
    return combine_first(new, rescale(old, verdicts)), verdicts


def add_new_entities(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of entities the store has never seen are appended."""
    return stored.unionByName(fresh.join(stored.select("entity").distinct(), "entity", "left_anti"))


def degraded(new: DataFrame, stored: DataFrame, share: float = 0.5) -> DataFrame:
    """One row: how many known entities the window covers, and whether that is too few."""
    known = stored.select("entity").distinct()
    seen = new.where(F.col("close").isNotNull()).select("entity").distinct().withColumn("__s", F.lit(1))
    g = known.join(seen, "entity", "left").agg(F.count(F.lit(1)).alias("known"), F.count("__s").alias("covered"))
    return g.withColumn("degraded", F.col("covered") < F.col("known") * share)


def freshness(bars: DataFrame, today, limit: int = 5) -> DataFrame:
    """One row: last bar, weekdays behind ``today`` and whether that is within the limit."""
    last = bars.agg(F.max("date").alias("last"))
    d = last.withColumn("stale", weekdays_between(F.col("last"), F.lit(today).cast("date")))
    return d.withColumn("fresh", F.coalesce(F.col("stale") <= limit, F.lit(False)))


def require_fresh(bars: DataFrame, today, limit: int = 5) -> None:
    row = freshness(bars, today, limit).first()
    if not row["fresh"]:
        raise ValueError(f"prices end {row['last']}, {row['stale']} weekdays behind {today} (limit {limit})")
