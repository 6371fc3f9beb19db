"""Analyst overrides: validation with rejects kept visible, and the scoreboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted directions and reason codes.
DIRECTIONS = ("less_risky", "more_risky")
REASON_CODES = (
    "corporate_action",
    "accounting_artifact",
    "data_error",
    "new_information",
    "structural_peer_mismatch",
    "thesis_disagreement",
)
MAX_AGE_MONTHS = 6


def typed_overrides(raw: DataFrame) -> DataFrame:
    """All-string rows to typed rows with ``valid``; a missing expiry is six months after filing."""
    day = F.to_date(F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd")))
    expires = F.to_date(F.try_to_timestamp(F.col("expires"), F.lit("yyyy-MM-dd")))
    d = raw.select(
        day.alias("date"), F.upper(F.trim("entity")).alias("entity"), "analyst", "direction", "reason_code", "factor", "note",
        F.coalesce(expires, F.add_months(day, MAX_AGE_MONTHS)).alias("expires"),
    )
    ok = (
        F.col("date").isNotNull()
        & F.col("direction").isin(*DIRECTIONS)
        & F.col("reason_code").isin(*REASON_CODES)
        & (F.col("entity") != "")
        & (F.trim("analyst") != "")
    )
    return d.withColumn("valid", F.coalesce(ok, F.lit(False)))


def accepted(typed: DataFrame) -> DataFrame:
    return typed.where(F.col("valid")).drop("valid")


def rejected(typed: DataFrame) -> DataFrame:
    return typed.where(~F.col("valid")).drop("valid")


def scored_observations(overrides: DataFrame, df: DataFrame, label: str) -> DataFrame:
    """Every realised cross section inside an override's life, and who was right.

    Both sides meet on (entity, quarter), so an entity with very many rows is spread over its quarters and an override
    meets only the quarters it lives in."""
    o = overrides.select("entity", "analyst", "direction", "reason_code", F.col("date").alias("filed"), "expires")
    lab = df.where(F.col(label).isNotNull()).select("entity", "date", F.col(label).alias("rel_ret"), F.trunc("date", "quarter").alias("__q"))
    span = lab.agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"))
    o = o.join(F.broadcast(span), F.lit(True)).withColumn("__a", F.greatest("filed", "__lo")).withColumn("__b", F.least("expires", "__hi"))
    o = o.where(F.col("filed").isNotNull() & F.col("expires").isNotNull() & (F.col("__a") <= F.col("__b")))
    quarters = F.sequence(F.trunc("__a", "quarter"), F.trunc("__b", "quarter"), F.expr("interval 3 months"))
    o = o.withColumn("__q", F.explode(quarters)).drop("__lo", "__hi", "__a", "__b")
    j = o.join(lab, ["entity", "__q"]).where((F.col("date") >= F.col("filed")) & (F.col("date") <= F.col("expires"))).drop("__q")
    right = (F.col("rel_ret") < 0) == (F.col("direction") == "more_risky")
    return j.withColumn("analyst_correct", right)


def scoreboard(obs: DataFrame) -> DataFrame:
    """Hit rates by reason code with an overall row; the model's call is the analyst's opposite."""
    hit = F.avg(F.col("analyst_correct").cast("double"))
    aggs = [F.count(F.lit(1)).alias("n_obs"), hit.alias("analyst_hit_rate"), (1 - hit).alias("model_hit_rate"), F.avg("rel_ret").alias("avg_rel_ret")]
    return obs.groupBy("reason_code").agg(*aggs).unionByName(obs.agg(F.lit("ALL").alias("reason_code"), *aggs))
