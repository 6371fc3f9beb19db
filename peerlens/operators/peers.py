"""Peer-group normalisation: winsorise, standardise, rank and bucket inside groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import EPS, bucket_of, clip, quantile_bin, row_count, row_mean, tier_of
from ..session import cheap, stage
from .ranking import attach, average_rank, group_quantiles, numbered, sized

PEER_KEYS = ("date", "sector", "index_name")

# Risk tiers as half-open percentile ranges.
RISK_TIERS = ((0.0, 30.0, "Stable"), (30.0, 70.0, "Mainstream"), (70.0, 100.01, "Elevated"))


def drop_small_groups(df: DataFrame, keys: Sequence[str] = PEER_KEYS, min_rows: int = 5, large: bool | None = None) -> DataFrame:
    """Keep only groups with at least ``min_rows`` rows (rows, not present values)."""

    def steps(d: DataFrame, large: bool) -> DataFrame:
        if not large:
            n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
            return d.withColumn("__rows", n).where(F.col("__rows") >= min_rows).drop("__rows")
        sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
        return attach(d, sizes, keys).where(F.col("__rows") >= min_rows).drop("__rows")

    return sized(df, keys, large, steps)


def winsorize(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], pct: float, min_count: int = 3, suffix: str = "_w", large: bool | None = None
) -> DataFrame:
    """Clip each column at its exact pct and 1-pct quantiles inside the group.

    Columns with fewer than ``min_count`` present values in a group pass unchanged.
    """
    probs = F.array(F.lit(float(pct)), F.lit(1.0 - pct))

    def steps(d: DataFrame, large: bool) -> DataFrame:
        if large:
            base = stage(d)
            stats = attach(base, group_quantiles(base, keys, cols, [pct, 1.0 - pct], True), keys)
        else:
            w = Window.partitionBy(*keys)
            stats = d.select(
                "*",
                *[F.percentile(c, probs).over(w).alias(f"{c}_q") for c in cols],
                *[F.count(c).over(w).alias(f"{c}_c") for c in cols],
            )
        return stats.select(
            *d.columns,
            *[
                F.when(F.col(f"{c}_c") >= min_count, clip(c, F.col(f"{c}_q")[0], F.col(f"{c}_q")[1]))
                .otherwise(F.col(c))
                .alias(f"{c}{suffix}")
                for c in cols
            ],
        )

    return sized(df, keys, large, steps)


def _standard(x: Column, mu: Column, sd: Column) -> Column:
    return F.when(sd > EPS, (x - mu) / sd).otherwise(x * 0.0)


def standardize(
    df: DataFrame, pairs: Mapping[str, str], keys: Sequence[str] = PEER_KEYS, signs: Mapping[str, int] | None = None,
    large: bool | None = None,
) -> DataFrame:
    """z-score (population sd) of each source column inside its group; constant groups give 0."""
    signs = signs or {}

    def steps(d: DataFrame, large: bool) -> DataFrame:
        if large:
            base = stage(d)
            per_group = base.groupBy(*keys).agg(
                *[F.avg(c).alias(f"__mu_{c}") for c in pairs], *[F.stddev_pop(c).alias(f"__sd_{c}") for c in pairs]
            )
            stats = attach(base, per_group, keys)
        else:
            w = Window.partitionBy(*keys)
            stats = d.select(
                "*",
                *[F.avg(c).over(w).alias(f"__mu_{c}") for c in pairs],
                *[F.stddev_pop(c).over(w).alias(f"__sd_{c}") for c in pairs],
            )
        return stats.select(
            *d.columns,
            *[
                (_standard(F.col(c), F.col(f"__mu_{c}"), F.col(f"__sd_{c}")) * F.lit(float(signs.get(c, 1)))).alias(out)
                for c, out in pairs.items()
            ],
        )

    return sized(df, keys, large, steps)


def neutralize(
    df: DataFrame, factors: Mapping[str, int], keys: Sequence[str] = PEER_KEYS, pct: float = 0.02, min_rows: int = 5,
    method: str = "zscore", entity: str = "entity", large: bool | None = None,
) -> DataFrame:
    """Add ``<factor>__n``: winsorised, peer-standardised and sign-aligned, so that larger
    always means a stronger warning. Groups below ``min_rows`` rows are dropped."""
    if method not in ("zscore", "rank"):
        raise ValueError(f"unknown method {method!r}")
    names = list(factors)

    def steps(d: DataFrame, large: bool) -> DataFrame:
        clipped = winsorize(drop_small_groups(d, keys, min_rows, large), names, keys, pct, large=large)
        if method == "zscore":
            signs = {f"{f}_w": s for f, s in factors.items()}
            out = standardize(clipped, {f"{f}_w": f"{f}__n" for f in names}, keys, signs, large)
        else:
            out = clipped
            for f in names:
                out = out.withColumn(f"{f}_w", F.round(f"{f}_w", 9))
                out = average_rank(out, keys, f"{f}_w", "__rk", [entity], large)
                pct_rank = F.col("__rk") / F.col("__rk_n") - 0.5
                out = out.withColumn(f"{f}__n", pct_rank * F.lit(float(factors[f]))).drop("__rk", "__rk_n")
        return out.drop(*[f"{f}_w" for f in names])

    return sized(df, keys, large, steps)


def peer_decile(
    df: DataFrame, score: str, out: str, keys: Sequence[str] = PEER_KEYS, buckets: int = 10, entity: str = "entity",
    large: bool | None = None,
) -> DataFrame:
    """Equal-count buckets of the present scores of a group, ties by entity; 1 is the lowest score."""

    def steps(d: DataFrame, large: bool) -> DataFrame:
        tmp = d.withColumn("__s", F.round(score, 9)).withColumn("__missing", F.col(score).isNull())
        ranked = numbered(tmp, [*keys, "__missing"], ["__s", entity], "__k", "__m", large)
        bucket = bucket_of(F.col("__k"), F.col("__m"), buckets)
        return ranked.withColumn(out, F.when(~F.col("__missing"), bucket)).drop("__s", "__missing", "__k", "__m")

    return sized(df, keys, large, steps)


def calibration_bins(
    df: DataFrame, score: str, out: str = "score_q", by: Sequence[str] = ("date",), bins: int = 10,
    entity: str = "entity", large: bool | None = None,
) -> DataFrame:
    """Quantile bins of the rank inside each date; dates with fewer than 2*bins rows are dropped.
    Rows must already have the score present."""

    def steps(d: DataFrame, large: bool) -> DataFrame:
        tmp = cheap(d.withColumn("__s", F.round(score, 9)), d)
        ranked = numbered(tmp, by, ["__s", entity], "__k", "__m", large).where(F.col("__m") >= 2 * bins)
        return ranked.withColumn(out, quantile_bin(F.col("__k"), F.col("__m"), bins)).drop("__s", "__k", "__m")

    return sized(df, by, large, steps)


def percentile_rank(
    df: DataFrame, value: str, out: str, keys: Sequence[str] = ("date",), entity: str = "entity", scale: float = 1.0,
    large: bool | None = None,
) -> DataFrame:
    """Average rank over the number of present values, times ``scale``."""
    tmp = df.withColumn("__v", F.round(value, 9))
    ranked = average_rank(tmp, keys, "__v", "__rk", [entity], large)
    return ranked.withColumn(out, F.col("__rk") / F.col("__rk_n") * F.lit(scale)).drop("__v", "__rk", "__rk_n")


def relative_to_median(
    df: DataFrame, cols: Mapping[str, str], keys: Sequence[str] = PEER_KEYS, large: bool | None = None
) -> DataFrame:
    """Subtract the exact group median from each column."""

    def steps(d: DataFrame, large: bool) -> DataFrame:
        if large:
            base = stage(d)
            stats = attach(base, group_quantiles(base, keys, list(cols), [0.5], True), keys)
            return stats.select(*d.columns, *[(F.col(c) - F.col(f"{c}_q")[0]).alias(out) for c, out in cols.items()])
        w = Window.partitionBy(*keys)
        return d.select("*", *[(F.col(c) - F.percentile(c, F.lit(0.5)).over(w)).alias(out) for c, out in cols.items()])

    return sized(df, keys, large, steps)


def absolute_risk(
    df: DataFrame, features: Mapping[str, int], date: str = "date", pct: float = 0.02, entity: str = "entity",
    prefix: str = "risk", tiers: Sequence[tuple[float, float, str]] = RISK_TIERS, large: bool | None = None,
) -> DataFrame:
    """Whole-universe risk score per date: aligned z by date only, row mean, percentile and tier."""
    names = list(features)

    def steps(d: DataFrame, large: bool) -> DataFrame:
        clipped = winsorize(d, names, [date], pct, large=large)
        signs = {f"{f}_w": s for f, s in features.items()}
        z = standardize(clipped, {f"{f}_w": f"{f}__t" for f in names}, [date], signs, large).drop(*[f"{f}_w" for f in names])
        zs = [f"{f}__t" for f in names]
        scored = z.withColumn(f"n_{prefix}_used", row_count(zs)).withColumn(f"{prefix}_score", row_mean(zs))
        ranked = percentile_rank(scored, f"{prefix}_score", f"{prefix}_pct", [date], entity, 100.0, large)
        return ranked.withColumn(f"{prefix}_tier", tier_of(f"{prefix}_pct", tiers))

    return sized(df, [date], large, steps)
