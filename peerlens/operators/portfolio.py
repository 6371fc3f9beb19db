"""Equal-weight sleeves stepped on non-overlapping periods, with turnover, cost and metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import EPS
from .timeseries import cumulative_growth

PER_YEAR = 4


def run_sleeves(
    df: DataFrame, decile: str, sleeves: Mapping[str, Column], ret: str = "fwd_ret_1q", cost_bps: float = 10.0
) -> DataFrame:
    """(sleeve, date, gross, turnover, ret, n) for all sleeves in one pass over the panel.

    A row is held when its return and bucket are known and the sleeve's condition holds; the
    last date of the panel is never held. Turnover of equal weights follows from n, the previous
    n and their overlap, so holdings are never joined to each other: each row only looks at
    the date its entity was held before.
    """
    known = F.col(ret).isNotNull() & F.col(decile).isNotNull()
    tags = F.array(
        *[F.struct(F.lit(n).alias("sleeve"), F.coalesce(known & c, F.lit(False)).alias("held")) for n, c in sleeves.items()]
    )
    rows = df.select("date", "entity", F.col(ret).alias("__r"), F.explode(tags).alias("__t"))
    rows = rows.select("date", "entity", "__r", "__t.sleeve", "__t.held")
    before = F.lag("date").over(Window.partitionBy("entity", "sleeve", "held").orderBy("date"))
    pairs = rows.withColumn("__before", before).groupBy("sleeve", "date", "__before").agg(
        F.sum(F.when(F.col("held"), F.col("__r"))).alias("__s"), F.count(F.when(F.col("held"), 1)).alias("__n")
    )
    # from here on one row per sleeve and pair of dates
    per_date = Window.partitionBy("sleeve", "date")
    every = Window.partitionBy("sleeve")
    d = pairs.select(
        "sleeve", "date", "__before", "__n", F.sum("__s").over(per_date).alias("__sum"), F.sum("__n").over(per_date).alias("n"),
        F.max("date").over(every).alias("__last"),
    ).where((F.col("date") < F.col("__last")) & (F.col("n") > 0))
    dates = d.groupBy("sleeve", "date").agg(
        F.first("__sum").alias("__sum"), F.first("n").alias("n"),
        F.collect_list(F.struct("__before", "__n")).alias("__from"),
    )
    w = Window.partitionBy("sleeve").orderBy("date")
    dates = dates.withColumn("__pd", F.lag("date").over(w)).withColumn("np", F.lag("n").over(w))
    same = F.filter("__from", lambda x: x["__before"] == F.col("__pd"))
    both = F.aggregate(same, F.lit(0).cast("long"), lambda a, x: a + x["__n"])
    n, p, c = F.col("n").cast("double"), F.col("np").cast("double"), both.cast("double")
    moved = 0.5 * (c * F.abs(1 / n - 1 / p) + (n - c) / n + (p - c) / p)
    out = dates.withColumn("gross", F.col("__sum") / n).withColumn("turnover", F.when(F.col("np").isNull(), F.lit(0.5)).otherwise(moved))
    return out.select("sleeve", "date", "gross", "turnover", (F.col("gross") - F.col("turnover") * cost_bps / 1e4).alias("ret"), "n")


def standard_sleeves(decile: str, worst: int = 10) -> dict[str, Column]:
    """Own every scored name, and everything but the worst bucket."""
    return {"hold_all": F.lit(True), "avoid_worst": F.col(decile) < worst}


def hold_all(df: DataFrame, decile: str, ret: str = "fwd_ret_1q", cost_bps: float = 10.0) -> DataFrame:
    return run_sleeves(df, decile, {"hold_all": F.lit(True)}, ret, cost_bps).drop("sleeve")


def avoid_worst(df: DataFrame, decile: str, ret: str = "fwd_ret_1q", cost_bps: float = 10.0, worst: int = 10) -> DataFrame:
    return run_sleeves(df, decile, {"avoid_worst": F.col(decile) < worst}, ret, cost_bps).drop("sleeve")


def _cagr(growth: Column, n: Column) -> Column:
    return F.when(growth > 0, F.pow(growth, F.lit(float(PER_YEAR)) / n) - 1)


def metrics(periods: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total return, CAGR, volatility, Sharpe, worst drawdown and length per sleeve."""
    d = cumulative_growth(periods.where(F.col("ret").isNotNull()), "ret", keys)
    g = d.groupBy(*keys).agg(
        F.product(1 + F.col("ret")).alias("__g"),
        F.stddev_samp("ret").alias("__sd"),
        F.avg("ret").alias("__m"),
        F.min("drawdown").alias("max_drawdown"),
        F.count(F.lit(1)).alias("n_quarters"),
    )
    vol = F.col("__sd") * F.sqrt(F.lit(float(PER_YEAR)))
    return g.select(
        *keys,
        (F.col("__g") - 1).alias("total_return"),
        _cagr(F.col("__g"), F.col("n_quarters")).alias("cagr"),
        vol.alias("vol"),
        F.when(vol > EPS, F.col("__m") * PER_YEAR / vol).alias("sharpe"),
        "max_drawdown",
        "n_quarters",
    )


def versus_benchmark(periods: DataFrame, bench: DataFrame) -> DataFrame:
    """Hit rate on matched periods, and the sleeve's CAGR over all its periods minus the
    benchmark's over the matched ones."""
    m = periods.select("date", "ret").join(F.broadcast(bench), "date", "left").agg(
        F.product(1 + F.col("ret")).alias("__g"),
        F.count(F.lit(1)).alias("__n"),
        F.avg(F.when(F.col("bench_ret").isNotNull(), (F.col("ret") > F.col("bench_ret")).cast("double"))).alias("hit_rate_vs_bench"),
        F.product(1 + F.col("bench_ret")).alias("__bg"),
        F.count("bench_ret").alias("__bn"),
    )
    return m.select(
        "hit_rate_vs_bench",
        (_cagr(F.col("__g"), F.col("__n")) - _cagr(F.col("__bg"), F.col("__bn"))).alias("excess_cagr"),
    )


def relative_metrics(sleeves: DataFrame, strategy: str, base: str) -> DataFrame:
    """Strategy minus base on common dates, from (sleeve, date, ret); no row with fewer than two."""
    j = sleeves.groupBy("date").agg(
        F.max(F.when(F.col("sleeve") == strategy, F.col("ret"))).alias("ra"), F.max(F.when(F.col("sleeve") == base, F.col("ret"))).alias("rb")
    ).where(F.col("ra").isNotNull() & F.col("rb").isNotNull())
    diff = F.col("ra") - F.col("rb")
    g = j.agg(
        F.product(1 + F.col("ra")).alias("ga"),
        F.product(1 + F.col("rb")).alias("gb"),
        F.stddev_samp(diff).alias("sd"),
        F.avg(diff).alias("m"),
        F.avg((diff > 0).cast("double")).alias("hit"),
        F.count(F.lit(1)).alias("n_quarters"),
    ).where(F.col("n_quarters") >= 2)
    te = F.col("sd") * F.sqrt(F.lit(float(PER_YEAR)))
    return g.select(
        (_cagr(F.col("ga"), F.col("n_quarters")) - _cagr(F.col("gb"), F.col("n_quarters"))).alias("excess_cagr_vs_base"),
        te.alias("tracking_error"),
        F.when(te > EPS, F.col("m") * PER_YEAR / te).alias("ir_vs_base"),
        F.col("hit").alias("hit_rate_vs_base"),
        "n_quarters",
    )


def benchmark_sleeve(bench: DataFrame) -> DataFrame:
    """The benchmark's own periods, shaped like a sleeve."""
    return bench.where(F.col("bench_ret").isNotNull()).select("date", F.col("bench_ret").alias("ret"))


def by_year(sleeves: DataFrame, names: Sequence[str]) -> DataFrame:
    """Compounded return and length per calendar year, one pair of columns per sleeve."""
    aggs = []
    for k in names:
        mine = F.when(F.col("sleeve") == k, F.col("ret"))
        aggs.append((F.product(1 + mine) - 1).alias(k))
        aggs.append(F.count(mine).alias(f"{k}_n"))
    return sleeves.groupBy(F.year("date").alias("year")).agg(*aggs)


def by_regime(sleeves: DataFrame, names: Sequence[str], bench: DataFrame) -> DataFrame:
    """Mean return per sleeve when the benchmark rose and when it did not."""
    b = bench.where(F.col("bench_ret").isNotNull()).withColumn(
        "regime", F.when(F.col("bench_ret") > 0, "benchmark up").otherwise("benchmark down")
    )
    base = b.groupBy("regime").agg(F.count(F.lit(1)).alias("n_quarters"), F.avg("bench_ret").alias("benchmark"))
    per = sleeves.join(F.broadcast(b.select("date", "regime")), "date").groupBy("regime").agg(
        *[F.avg(F.when(F.col("sleeve") == k, F.col("ret"))).alias(k) for k in names]
    )
    return base.join(per, "regime", "left").select("regime", "n_quarters", *names, "benchmark")
