"""Grading scores: rank correlations per date, overlap-corrected inference, quantile tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import EPS, clip
from .peers import calibration_bins
from .ranking import attach, average_rank, correlation, group_quantiles, places, sized
from ..session import alone, cheap, durable

#: Numbers of a date that one task holds to rank them: 2 million rows with 16 columns, 256 MB.
HELD_NUMBERS = 32_000_000
PERIODS_PER_QUARTER = {"M": 3, "Q": 1}


def overlap_lags(months: int, freq: str = "M") -> int:
    """Lags that cover the overlap of adjacent labels, at least one."""
    return max(1, round(months * PERIODS_PER_QUARTER.get(freq, 1) / 3) - 1)


# --- rank correlation per date -------------------------------------------------------


def _correlation(r: DataFrame, keys: Sequence[str], rx: str, ry: str) -> DataFrame:
    moments = r.groupBy(*keys).agg(
        F.covar_pop(rx, ry).alias("__cov"), F.stddev_pop(rx).alias("__sx"), F.stddev_pop(ry).alias("__sy"), F.count(F.lit(1)).alias("n")
    )
    return moments.select(*keys, _rho(F.col("__cov"), F.col("__sx"), F.col("__sy")).alias("rho"), "n")


def _rho(cov: Column, sx: Column, sy: Column) -> Column:
    return F.when((sx > EPS) & (sy > EPS), cov / (sx * sy))


def rank_correlation(
    pairs: DataFrame, keys: Sequence[str], x: str = "s", y: str = "y", entity: str = "entity", large: bool | None = None
) -> DataFrame:
    """Spearman correlation per group as (keys, rho, n); NULL when either side is constant."""

    def steps(d: DataFrame, large: bool) -> DataFrame:
        r = average_rank(d, keys, x, "__rx", [entity], large)
        r = average_rank(r, keys, y, "__ry", [entity], large)
        return _correlation(r, keys, "__rx", "__ry")

    return sized(pairs, keys, large, steps)


def _correlations(rows: pa.Table, n_scores: int, n_labels: int) -> pa.Table:
    """(i, j, rho, n) of the rows of one date: score i against label j over the rows that have both.

    A column is sorted once and its order reused for all its pairs."""

    def column(c: str) -> tuple[np.ndarray, np.ndarray]:
        v = rows.column(c)
        return v.to_numpy(zero_copy_only=False), v.is_valid().to_numpy(zero_copy_only=False)

    def sorted_rows(v: np.ndarray, there: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(there)
        return at[np.argsort(v[at], kind="stable")].astype(np.int32)

    labels = []
    for j in range(n_labels):
        v, there = column(f"__y{j}")
        labels.append((v, there, sorted_rows(v, there)))
    ranked: dict[tuple[int, bytes], np.ndarray] = {}  # of a label, for each set of rows; scores mostly share one
    out, at = [], np.empty(rows.num_rows, np.int32)
    for i in range(n_scores):
        s, has_s = column(f"__s{i}")
        by_s = sorted_rows(s, has_s)
        for j, (y, has_y, by_y) in enumerate(labels):
            both = has_s & has_y
            n = int(both.sum())
            at[both] = np.arange(n, dtype=np.int32)
            rank_s = places(s[both], at[by_s[has_y[by_s]]])
            key = (j, hashlib.sha256(np.packbits(both)).digest())
            if key not in ranked:
                ranked = {k: r for k, r in ranked.items() if k[0] != j}
                ranked[key] = places(y[both], at[by_y[has_s[by_y]]])
            out.append((i, j, correlation(rank_s, ranked[key]), n))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.float64(), pa.int64()))], names=["i", "j", "rho", "n"])


def per_date(rows: DataFrame, date: str, found: Callable[[pa.Table], pa.Table], schema: str, order: Sequence[str] = (), **also: Column) -> DataFrame:
    """What ``found`` makes of the rows of each date, held by one task as plain numbers, next to the date: rows move once.

    They come sorted by ``order``; the columns ``also`` are made behind the move."""
    names = [*[c for c in rows.columns if c != date], *also]
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 128)  # about a date each: not to be merged

    def one(t: pa.Table) -> pa.Table:
        day = t.column(date).slice(0, 1).combine_chunks()
        got = found(t.select(names))
        return got.add_column(0, date, day.take(pa.array(np.zeros(got.num_rows, np.int64))))

    kind = rows.schema[date].dataType.simpleString()
    moved = rows.repartition(tasks, date)
    if order:
        moved = moved.sortWithinPartitions(date, *order)
    return moved.withColumns(also).groupBy(date).applyInArrow(one, f"`{date}` {kind}, {schema}")


def ranks_held(columns: int) -> int:
    """Rows of a date that one task holds with so many columns."""
    return HELD_NUMBERS // columns


def ic_series(
    df: DataFrame, scores: Mapping[str, str], labels: Mapping[str, str], min_rows: int = 10, date: str = "date",
    entity: str = "entity", large: bool | None = None,
) -> DataFrame:
    """Every score against every label in one grouped pass: (series, horizon, date, ic, n), ic = -Spearman.

    Values are rounded before ranking. Rows are never multiplied by series: a date whose numbers fit a task is ranked where its
    rows lie, after one move of the columns; the pairs of larger dates are ranked one after the other, so that only one of them lies on disk."""
    s_names, y_names = list(scores), list(labels)
    ss, ys = [f"__s{i}" for i in range(len(s_names))], [f"__y{j}" for j in range(len(y_names))]
    narrow = df.select(
        date, entity, *[F.round(scores[n], 9).cast("double").alias(c) for c, n in zip(ss, s_names)],
        *[F.round(labels[n], 9).cast("double").alias(c) for c, n in zip(ys, y_names)],
    )
    # a row without a score or without a label is in no pair
    narrow = cheap(narrow.where(F.coalesce(*ss).isNotNull() & F.coalesce(*ys).isNotNull()), df)

    def steps(d: DataFrame, large: bool) -> DataFrame:
        if not large:
            return per_date(d.drop(entity), date, partial(_correlations, n_scores=len(ss), n_labels=len(ys)), "i int, j int, rho double, n bigint")

        def pair(i: int, j: int) -> DataFrame:
            both = d.where(F.col(ss[i]).isNotNull() & F.col(ys[j]).isNotNull()).select(date, entity, F.col(ss[i]).alias("s"), F.col(ys[j]).alias("y"))
            return rank_correlation(both, [date], "s", "y", entity, True).select(date, F.lit(i).alias("i"), F.lit(j).alias("j"), "rho", "n")

        return reduce(DataFrame.unionByName, [alone(df.sparkSession, partial(pair, i, j)) for i in range(len(ss)) for j in range(len(ys))])

    rho = sized(narrow, [date], large, steps, ranks_held(len(ss) + len(ys)))
    name = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(c) + 1)
    return rho.where((F.col("n") >= min_rows) & F.col("rho").isNotNull()).select(
        name(s_names, "i").alias("series"), name(y_names, "j").alias("horizon"), date, (-F.col("rho")).alias("ic"), "n"
    )


# --- inference on a short series -------------------------------------------------------


def hac_mean(
    series: DataFrame, keys: Sequence[str], value: str, lags: int | Mapping[str, int], order: str = "date",
    horizon: str = "horizon",
) -> DataFrame:
    """Mean, overlap-corrected t (Bartlett weights, no small-sample factor), IR, hit rate and length.

    ``series`` holds one row per period and key: bounded by the calendar. ``lags`` is one
    number, or one per value of ``horizon``.
    """
    most = lags if isinstance(lags, int) else max(lags.values())
    if isinstance(lags, int):
        limit: Column = F.lit(lags)
    else:
        limit = F.lit(None).cast("int")
        for h, n in lags.items():
            limit = F.when(F.col(horizon) == h, F.lit(n)).otherwise(limit)
    limit = F.greatest(limit, F.lit(1))
    w = Window.partitionBy(*keys)
    x = series.where(F.col(value).isNotNull())
    x = x.withColumn("__e", F.col(value) - F.avg(value).over(w)).withColumn("__lim", limit)
    wo = w.orderBy(order)
    x = x.select(
        "*",
        *[
            F.when(
                F.col("__lim") >= k, F.col("__e") * F.lag("__e", k).over(wo) * (1 - F.lit(k) / (F.col("__lim") + 1))
            ).alias(f"__p{k}")
            for k in range(1, most + 1)
        ],
    )
    cross = F.lit(0.0)
    for k in range(1, most + 1):
        cross = cross + F.coalesce(F.sum(f"__p{k}"), F.lit(0.0))
    agg = x.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        (F.sum(F.col("__e") * F.col("__e")) + 2.0 * cross).alias("__s"),
        F.stddev_samp(value).alias("__sd"),
        F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"),
        F.count(F.lit(1)).alias("n_periods"),
    )
    n = F.col("n_periods")
    se = F.when((n >= 3) & (F.col("__s") > 1e-18), F.sqrt(F.col("__s")) / n)
    return agg.select(
        *keys,
        "mean",
        F.try_divide("mean", se).alias("t_stat"),
        se.alias("se"),
        F.when((n >= 3) & (F.col("__sd") > EPS), F.col("mean") / F.col("__sd")).alias("ir"),
        "hit_rate",
        "n_periods",
    )


def ic_summary(
    df: DataFrame, scores: Mapping[str, str], labels: Mapping[str, str], months: Mapping[str, int], freq: str = "M",
    min_rows: int = 10, large: bool | None = None,
) -> DataFrame:
    """Mean IC, t, IR, hit rate and periods per (series, horizon)."""
    ics = ic_series(df, scores, labels, min_rows, large=large)
    lags = {h: overlap_lags(m, freq) for h, m in months.items()}
    return hac_mean(ics, ["series", "horizon"], "ic", lags).withColumnRenamed("mean", "mean_ic")


def factor_ic_table(summary: DataFrame, groups: Mapping[str, str]) -> DataFrame:
    """Single-factor results with their family, best first."""
    mapping = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return (
        summary.withColumn("family", F.coalesce(mapping[F.col("series")], F.lit("Other")))
        .withColumnRenamed("series", "factor")
        .orderBy(F.col("mean_ic").desc_nulls_last(), "factor")
    )


def paired_test(ics: DataFrame, a: str, b: str, lags: int, bar: float = 1.645) -> DataFrame:
    """Overlap-corrected test of the date-aligned IC difference a - b, with the promotion decision."""
    left = ics.where(F.col("series") == a).select("date", F.col("ic").alias("__a"))
    right = ics.where(F.col("series") == b).select("date", F.col("ic").alias("__b"))
    diff = left.join(right, "date").select("date", (F.col("__a") - F.col("__b")).alias("diff"), F.lit(1).alias("one"))
    res = hac_mean(diff, ["one"], "diff", lags)
    few = F.col("n_periods") < 3
    promote = F.coalesce((F.col("mean") > 0) & (F.col("t_stat") >= bar), F.lit(False))
    return res.select(
        F.when(~few, F.col("mean")).alias("mean_diff"),
        F.when(~few, F.col("t_stat")).alias("t_stat"),
        "n_periods",
        promote.alias("promote"),
    )


def promotion_decision(
    paired: DataFrame, was_promoted: Column, floor: float = 0.0, challenger: str = "score_ml", baseline: str = "score_ew"
) -> DataFrame:
    """Hysteresis: a challenger must clear the bar, an incumbent only has to stay above ``floor``."""
    keep = F.coalesce(F.col("t_stat") >= floor, F.lit(False))
    decided = paired.withColumn("was_promoted", was_promoted)
    decision = (
        F.when(F.col("was_promoted") & keep, "retained (hysteresis)")
        .when(F.col("was_promoted"), "demoted")
        .when(F.col("promote"), "promoted")
        .otherwise("baseline kept")
    )
    final = F.when(F.col("was_promoted"), keep).otherwise(F.col("promote"))
    return decided.withColumn("decision", decision).withColumn("promote", final).withColumn(
        "default_score", F.when(F.col("promote"), challenger).otherwise(baseline)
    )


# --- label clipping --------------------------------------------------------------------


def clip_labels(
    df: DataFrame, label: str, out: str, keys: Sequence[str], pct: float = 0.01, min_count: int = 10, large: bool | None = None
) -> DataFrame:
    """Clip a label at exact quantiles inside ``keys``; groups below ``min_count`` pass unchanged.

    Keys may be few and groups large (even one pooled group), so bounds come from an
    aggregate and are joined back rather than computed over a window."""
    bounds = group_quantiles(df.where(F.col(label).isNotNull()), keys, [label], [pct, 1.0 - pct], large)
    bounds = bounds.select(*keys, F.col(f"{label}_q").alias("__q"), F.col(f"{label}_c").alias("__c"))
    joined = attach(df, bounds, keys)
    return joined.withColumn(
        out, F.when(F.col("__c") >= min_count, clip(label, F.col("__q")[0], F.col("__q")[1])).otherwise(F.col(label))
    ).drop("__q", "__c")


# --- decile tables ------------------------------------------------------------------------


def decile_table(df: DataFrame, decile: str, label: str, large: bool | None = None) -> DataFrame:
    """Pooled mean, median, winsorised mean and count of the label per decile."""
    d = df.select("date", "entity", F.col(decile).alias("decile"), F.col(label).alias("y")).dropna()
    d = durable(clip_labels(d, "y", "__w", [], large=large))
    means = d.groupBy("decile").agg(
        F.avg("y").alias("mean_rel_ret"), F.avg("__w").alias("mean_rel_ret_w"), F.count(F.lit(1)).alias("n")
    )
    medians = group_quantiles(d, ["decile"], ["y"], [0.5], large).select(
        "decile", F.col("y_q")[0].alias("median_rel_ret")
    )
    return means.join(medians, "decile")


def decile_spread(df: DataFrame, decile: str, label: str, buckets: int = 10) -> DataFrame:
    """Mean of the best bucket minus mean of the worst, per date that has both."""
    d = df.where(F.col(decile).isNotNull() & F.col(label).isNotNull())
    s = d.groupBy("date").agg(
        (
            F.avg(F.when(F.col(decile) == 1, F.col(label))) - F.avg(F.when(F.col(decile) == buckets, F.col(label)))
        ).alias("spread")
    )
    return s.where(F.col("spread").isNotNull())


def monotonicity(table: DataFrame) -> DataFrame:
    """Spearman of decile against its mean label, for three deciles or more."""
    one = table.select(
        F.lit(1).alias("one"), F.col("decile").cast("double").alias("s"), F.round("mean_rel_ret", 9).alias("y"),
        F.col("decile").alias("entity"),
    )
    # one row per decile
    return rank_correlation(one, ["one"], large=False).select(F.when(F.col("n") >= 3, F.col("rho")).alias("rho"), "n")


def calibration_table(df: DataFrame, score: str, label: str, bins: int = 10, large: bool | None = None) -> DataFrame:
    """Score-quantile response: binned within each date, then averaged across dates with standard errors."""
    d = df.select("date", "entity", F.col(score).alias("score"), F.col(label).alias("y")).dropna()

    def steps(d: DataFrame, large: bool) -> DataFrame:
        binned = clip_labels(calibration_bins(d, "score", "score_q", bins=bins, large=large), "y", "__w", ["date"], large=large)
        aggs = [
            F.avg("y").alias("m"),
            F.avg("__w").alias("mw"),
            F.avg((F.col("y") < 0).cast("double")).alias("p"),
            F.avg("score").alias("sc"),
            F.count(F.lit(1)).alias("c"),
        ]
        return _with_median(binned, ["date", "score_q"], "y", aggs, large)

    per = sized(d, ["date"], large, steps)
    root = F.sqrt(F.count(F.lit(1)))
    out = per.groupBy("score_q").agg(
        F.avg("m").alias("mean_rel_ret"),
        (F.stddev_samp("m") / root).alias("se"),
        F.avg("med").alias("median_rel_ret"),
        F.avg("mw").alias("mean_rel_ret_w"),
        F.avg("p").alias("p_underperform"),
        (F.stddev_samp("p") / root).alias("p_underperform_se"),
        F.avg("sc").alias("mean_score"),
        F.count(F.lit(1)).alias("n_dates"),
        F.sum("c").alias("n_obs"),
    )
    return out.withColumn("t_stat", F.when(F.col("se") > EPS, F.col("mean_rel_ret") / F.col("se")))


def _with_median(df: DataFrame, keys: Sequence[str], label: str, aggs: Sequence[Column], large: bool) -> DataFrame:
    """Aggregates per group and the exact median as ``med``."""
    if not large:
        return df.groupBy(*keys).agg(*aggs, F.percentile(label, F.lit(0.5)).alias("med"))
    base = durable(df)
    meds = group_quantiles(base, keys, [label], [0.5], True)
    return attach(base.groupBy(*keys).agg(*aggs), meds.select(*keys, F.col(f"{label}_q")[0].alias("med")), keys)


# --- segmentation -----------------------------------------------------------------------


def coverage_eras(df: DataFrame, min_avg: float = 4.0) -> DataFrame:
    """Average factor coverage per date and its era label."""
    avg = df.groupBy("date").agg(F.avg("n_factors_used").alias("avg_factors"))
    return avg.withColumn("era", F.when(F.col("avg_factors") >= min_avg, "full factor").otherwise("price only"))


def ic_by_segment(ics: DataFrame, segments: DataFrame, name: str, lags: int) -> DataFrame:
    """Overlap-corrected summary per segment; ``segments`` maps date to ``name`` (one row per date)."""
    tagged = ics.join(F.broadcast(segments.select("date", name)), "date").where(F.col(name).isNotNull())
    return hac_mean(tagged, [name], "ic", lags).withColumnRenamed("mean", "mean_ic")


def ic_by_year(ics: DataFrame) -> DataFrame:
    return ics.groupBy(F.year("date").alias("year")).agg(
        F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("n_periods")
    )


def rolling_mean_ic(ics: DataFrame, window: int = 12) -> DataFrame:
    """Trailing mean of each series' IC over its own periods, at least half a window (and three)."""
    w = Window.partitionBy("series").orderBy("date").rowsBetween(-(window - 1), 0)
    enough = F.count("ic").over(w) >= max(3, window // 2)
    return ics.select("series", "date", F.when(enough, F.avg("ic").over(w)).alias("rolling_ic"))


def trailing_volatility(bench: DataFrame, window: int = 63, per_year: int = 252) -> DataFrame:
    """Annualised trailing volatility of a single price series, (session_no, date, vol)."""
    every = Window.orderBy("session_no")  # one benchmark row per session: bounded by the calendar
    r = bench.withColumn("__r", F.col("close") / F.lag("close").over(every) - 1)
    w = every.rowsBetween(-(window - 1), 0)
    enough = F.count("__r").over(w) >= window
    return r.select(
        "session_no", "date", F.when(enough, F.stddev_samp("__r").over(w) * F.sqrt(F.lit(float(per_year)))).alias("vol")
    )


def enough_periods(dated: DataFrame, least: int) -> DataFrame:
    """All rows of a short series (one per date), or none if there are fewer than ``least``."""
    every = Window.partitionBy(F.lit(1))
    return dated.withColumn("__n", F.count(F.lit(1)).over(every)).where(F.col("__n") >= least).drop("__n")


def terciles(dated: DataFrame, value: str, names: Sequence[str] = ("calm", "normal", "stressed")) -> DataFrame:
    """Full-sample tercile label per row of a short series, cuts right-closed."""
    cuts = dated.agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("__c"))
    j = dated.join(F.broadcast(cuts), F.lit(True))
    v = F.round(value, 12)
    label = F.when(v <= F.round(F.col("__c")[0], 12), names[0]).when(v <= F.round(F.col("__c")[1], 12), names[1])
    return j.withColumn("regime", F.when(F.col(value).isNotNull(), label.otherwise(names[2]))).drop("__c")


def stress_windows(
    windows: DataFrame, ics: DataFrame, spreads: DataFrame, bench: DataFrame | None = None
) -> DataFrame:
    """Mean IC, periods, mean spread and benchmark move inside named periods (name, start, end).

    Every input is at most one row per date; empty windows keep their row with NULLs."""
    win = F.broadcast(windows)
    inside = (F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end"))
    a = ics.join(win, inside).groupBy("name").agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("n"))
    b = spreads.join(win, inside).groupBy("name").agg(F.avg("spread").alias("spread_mean"))
    out = windows.join(a, "name", "left").join(b, "name", "left")
    if bench is not None:
        c = (
            bench.where(F.col("close").isNotNull())
            .join(win, inside)
            .groupBy("name")
            .agg(
                F.when(
                    F.count(F.lit(1)) > 1, F.max_by("close", "date") / F.min_by("close", "date") - 1
                ).alias("bench_return")
            )
        )
        out = out.join(c, "name", "left")
    else:
        out = out.withColumn("bench_return", F.lit(None).cast("double"))
    return out.select(
        "name", "start", "end", "mean_ic", F.coalesce("n", F.lit(0)).cast("long").alias("n_periods"), "spread_mean",
        "bench_return",
    )


def exposures(df: DataFrame, decile: str, traits: Sequence[str], sector: str = "sector", worst: int = 10) -> DataFrame:
    """Mean of per-date means in the worst bucket and in everything scored, plus the largest sector share."""
    d = df.where(F.col(decile).isNotNull())
    flag = F.col(decile) == worst
    per = d.groupBy("date").agg(
        *[F.avg(F.when(flag, F.col(t))).alias(f"w_{t}") for t in traits], *[F.avg(t).alias(f"u_{t}") for t in traits]
    )
    means = per.agg(*[F.avg(c).alias(c) for c in per.columns if c != "date"])
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("metric"), F.col(f"w_{t}").alias("flagged"), F.col(f"u_{t}").alias("universe")
                )
                for t in traits
            ]
        )
    )
    part = means.select(rows.alias("r")).select("r.*").where(F.col("universe").isNotNull())
    counts = d.groupBy("date", sector).agg(F.count(F.when(flag, 1)).alias("cw"), F.count(F.lit(1)).alias("cu"))
    share = counts.groupBy("date").agg(
        F.try_divide(F.max("cw"), F.sum("cw")).alias("sw"), F.try_divide(F.max("cu"), F.sum("cu")).alias("su")
    )
    shares = share.agg(
        F.lit("largest sector share").alias("metric"), F.avg("sw").alias("flagged"), F.avg("su").alias("universe")
    )
    return part.unionByName(shares)


# --- after the flag -------------------------------------------------------------------------


def event_study(
    df: DataFrame, decile: str, label: str, period: str = "period_no", steps: int = 4, worst: int = 10, large: bool | None = None
) -> DataFrame:
    """Mean label path after an entity is flagged, for all flags and for new entrants.

    ``period`` is the position of the date in the list of dates."""
    per_entity = Window.partitionBy("entity").orderBy(period)  # one row per entity and date
    d = df.select("entity", "date", period, F.col(decile).alias("d"), F.col(label).alias("y"))
    prev = F.max("d").over(per_entity.rangeBetween(-1, -1))
    d = d.withColumn("__prev", prev)
    for k in range(steps):
        d = d.withColumn(f"__y{k}", F.max("y").over(per_entity.rangeBetween(k, k)))
    flagged = d.where(F.col("d") == worst)
    cohorts = F.explode(
        F.when(F.coalesce(F.col("__prev") != worst, F.lit(False)), F.array(F.lit("all"), F.lit("entrant"))).otherwise(
            F.array(F.lit("all"))
        )
    )
    path = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__y{k}").alias("y")) for k in range(steps)])
    )
    ev = (
        flagged.withColumn("cohort", cohorts)
        .select("entity", "date", "cohort", path.alias("p"))
        .select("entity", "date", "cohort", "p.k", "p.y")
        .where(F.col("y").isNotNull())
    )
    ev = clip_labels(ev, "y", "__w", ["cohort", "k"], large=large)
    g = ev.groupBy("cohort", "k").agg(
        F.avg("y").alias("mean_rel_ret"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("y") / F.sqrt(F.count(F.lit(1)))).alias("se"),
        F.avg("__w").alias("mean_rel_ret_w"),
        F.count(F.lit(1)).alias("n"),
    )
    spark = df.sparkSession
    grid = spark.range(steps).select(
        F.col("id").cast("int").alias("k"), F.explode(F.array(F.lit("all"), F.lit("entrant"))).alias("cohort")
    )
    full = grid.join(g, ["cohort", "k"], "left")
    cum = F.sum("mean_rel_ret").over(Window.partitionBy("cohort").orderBy("k"))
    return full.select(
        "cohort",
        "k",
        "mean_rel_ret",
        "se",
        "mean_rel_ret_w",
        F.when(F.col("mean_rel_ret").isNotNull(), cum).alias("cum_mean"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def risk_reliability(df: DataFrame, label: str, pct: str = "risk_pct", large: bool | None = None) -> DataFrame:
    """Frequency of damage per risk decile: per date first, then averaged across dates."""
    d = df.select("date", "entity", F.col(pct).alias("p"), F.col(label).alias("y")).dropna()
    bucket = F.least(F.greatest(F.ceil(F.round(F.col("p"), 9) / 10.0), F.lit(1)), F.lit(10)).cast("int")
    d = d.withColumn("risk_decile", bucket)
    keys = ["date", "risk_decile"]
    aggs = [
        F.avg((F.col("y") <= -0.20).cast("double")).alias("p20"),
        F.avg((F.col("y") <= -0.50).cast("double")).alias("p50"),
        F.avg("y").alias("m"),
        F.count(F.lit(1)).alias("c"),
    ]
    per = sized(d, keys, large, lambda rows, large: _with_median(rows, keys, "y", aggs, large))
    return per.groupBy("risk_decile").agg(
        F.avg("p20").alias("p_loss20"),
        F.avg("p50").alias("p_loss50"),
        F.avg("m").alias("mean_abs_ret"),
        F.avg("med").alias("median_abs_ret"),
        F.sum("c").alias("n_obs"),
        F.count(F.lit(1)).alias("n_dates"),
    )
