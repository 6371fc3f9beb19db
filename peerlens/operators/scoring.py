"""Combining aligned factors into family-balanced, evidence-weighted and interaction scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import row_count, row_mean
from ..session import cheap
from .evaluation import ic_series
from .peers import PEER_KEYS, peer_decile, standardize
from .ranking import sized


def family_column(family: str) -> str:
    return f"fam_{family.replace(' ', '_').lower()}__score"


def family_scores(df: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """One mean per family over the present factors, with factor and family counts."""
    out = df.select(
        "*", *[row_mean([f"{f}__n" for f in fs]).alias(family_column(g)) for g, fs in families.items()]
    )
    return out.withColumn(
        "n_factors_used", row_count([f"{f}__n" for fs in families.values() for f in fs])
    ).withColumn("n_families_used", row_count([family_column(g) for g in families]))


def balanced_score(
    df: DataFrame, families: Mapping[str, Sequence[str]], keys: Sequence[str] = PEER_KEYS, min_factors: int = 3,
    min_families: int = 2, buckets: int = 10, large: bool | None = None,
) -> DataFrame:
    """Mean of family means with coverage floors, re-standardised in the peer group, then bucketed."""
    fam = family_scores(df, families)
    thin = (F.col("n_factors_used") < min_factors) | (F.col("n_families_used") < min_families)
    raw = fam.withColumn("score_ew_raw", F.when(~thin, row_mean([family_column(g) for g in families])))
    return _graded(raw, "score_ew_raw", "score_ew", "decile_ew", keys, buckets, large)


def _graded(df: DataFrame, raw: str, score: str, decile: str, keys: Sequence[str], buckets: int, large: bool | None) -> DataFrame:
    """Standardised in the peer group, then bucketed."""

    def steps(d: DataFrame, large: bool) -> DataFrame:
        return peer_decile(standardize(d, {raw: score}, keys, large=large), score, decile, keys, buckets, large=large)

    return sized(df, keys, large, steps)


def interactions(
    df: DataFrame, terms: Mapping[str, tuple[str, str]], keys: Sequence[str] = PEER_KEYS, large: bool | None = None
) -> DataFrame:
    """Products of two family scores, re-standardised in the peer group, as ``<name>__n``."""
    prod = df.select(
        "*", *[(F.col(family_column(a)) * F.col(family_column(b))).alias(f"__{n}") for n, (a, b) in terms.items()]
    )
    return standardize(prod, {f"__{n}": f"{n}__n" for n in terms}, keys, large=large).drop(*[f"__{n}" for n in terms])


def evidence_weights(
    ics: DataFrame, dates: DataFrame, families: Sequence[str], embargo_months: int, window: int = 36,
    shrink: float = 0.5, min_realized: int = 12,
) -> DataFrame:
    """Family weights per date from the trailing mean of realised ICs.

    ``ics`` is (family, date, ic), ``dates`` one row per scoring date; both are tiny
    (families x dates), whatever the size of the panel behind them.
    """
    grid = dates.select("date", F.explode(F.array(*[F.lit(f) for f in families])).alias("family"))
    realised = ics.select(F.col("family").alias("of_family"), F.col("date").alias("s"), "ic")
    known = grid.join(
        realised,
        (F.col("family") == F.col("of_family")) & (F.col("s") <= F.add_months("date", -embargo_months)),
        "left",
    )
    recent = known.withColumn(
        "k", F.row_number().over(Window.partitionBy("date", "family").orderBy(F.col("s").desc_nulls_last()))
    ).where(F.col("k") <= window)
    per = recent.groupBy("date", "family").agg(
        F.count("ic").alias("n"), F.greatest(F.coalesce(F.avg("ic"), F.lit(0.0)), F.lit(0.0)).alias("pos")
    )
    w = Window.partitionBy("date")
    f_n = float(len(families))
    per = per.withColumn("n_realized", F.min("n").over(w)).withColumn("total", F.sum("pos").over(w))
    blended = (1.0 - shrink) / f_n + shrink * F.try_divide(F.col("pos"), F.col("total"))
    weight = F.when((F.col("n_realized") < min_realized) | (F.col("total") <= 0), F.lit(1.0 / f_n)).otherwise(blended)
    return per.select("date", "family", weight.alias("weight"), F.col("n_realized").cast("long").alias("n_realized"))


def apply_weights(df: DataFrame, weights: DataFrame, families: Sequence[str], out: str) -> DataFrame:
    """Weighted mean over the families a row has, weights renormalised per row."""
    wide = weights.groupBy("date").agg(
        *[F.max(F.when(F.col("family") == f, F.col("weight"))).alias(f"__w_{i}") for i, f in enumerate(families)]
    )
    # one row per date: bounded by the calendar
    joined = df.join(F.broadcast(wide), "date", "left")
    num, den = F.lit(0.0), F.lit(0.0)
    for i, f in enumerate(families):
        have = F.col(family_column(f)).isNotNull()
        num = num + F.when(have, F.col(family_column(f)) * F.col(f"__w_{i}")).otherwise(0.0)
        den = den + F.when(have, F.col(f"__w_{i}")).otherwise(0.0)
    return joined.withColumn(out, F.try_divide(num, den)).drop(*[f"__w_{i}" for i in range(len(families))])


def evidence_weighted_score(
    df: DataFrame, families: Sequence[str], label: str, months: int, selection: str | None = None,
    keys: Sequence[str] = PEER_KEYS, window: int = 36, shrink: float = 0.5, min_realized: int = 12,
    min_factors: int = 3, min_families: int = 2, buckets: int = 10, min_rows: int = 10, large: bool | None = None,
    large_peers: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Blend family scores by trailing realised IC; returns (scored rows, weight history).

    ``large`` is the form of dates, ``large_peers`` that of peer groups if it is known apart."""
    est = cheap(df.where(F.col("index_name") == selection), df) if selection else df
    ics = ic_series(est, {f: family_column(f) for f in families}, {"h": label}, min_rows=min_rows, large=large)
    ics = ics.select(F.col("series").alias("family"), "date", "ic")
    weights = evidence_weights(ics, df.select("date").distinct(), families, months, window, shrink, min_realized)
    raw = apply_weights(df, weights, families, "__icw")
    thin = (F.col("n_factors_used") < min_factors) | (F.col("n_families_used") < min_families)
    raw = raw.withColumn("score_icw_raw", F.when(~thin, F.col("__icw"))).drop("__icw")
    return _graded(raw, "score_icw_raw", "score_icw", "decile_icw", keys, buckets, large if large_peers is None else large_peers), weights
