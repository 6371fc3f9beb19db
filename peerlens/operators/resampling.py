"""Seeded resampling by hashing: random sleeves, within-date permutation, random composites.

Every draw is a hash of (seed, trial, key), so a recomputed task redraws the same sample.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import alone, cheap, durable, held
from .evaluation import ic_series, per_date, rank_correlation
from .ranking import correlation, numbered, places, sized

# Screening tiers, as the largest bucket a name may sit in.
TIERS = {"full": 10, "ex10": 9, "ex9_10": 8, "top_half": 5}
PERCENTILES = (5, 25, 50, 75, 95)
#: Rows of a date that one task holds as plain numbers: about 150 bytes each for seven factors.
HELD_ROWS = 4_000_000
#: Keys that are hashed at once.
MD5_ROWS = 65_536


def tier_pools(
    df: DataFrame, decile: str, ret: str = "fwd_ret_1q", names: int = 20, tiers: Mapping[str, int] = TIERS
) -> DataFrame:
    """(tier, date, entity, ret) for dates on which every tier can field ``names`` entities."""
    d = df.where(F.col(decile).isNotNull() & F.col(ret).isNotNull()).select(
        "date", "entity", F.col(decile).alias("__d"), F.col(ret).alias("ret")
    )
    sizes = d.groupBy("date").agg(*[F.count(F.when(F.col("__d") <= m, 1)).alias(t) for t, m in tiers.items()])
    enough = F.lit(True)
    for t in tiers:
        enough = enough & (F.col(t) >= names)
    usable = sizes.where(enough).select("date")
    member = F.filter(
        F.array(*[F.when(F.col("__d") <= m, F.lit(t)) for t, m in tiers.items()]), lambda x: x.isNotNull()
    )
    return d.join(F.broadcast(usable), "date", "left_semi").select("date", "entity", "ret", F.explode(member).alias("tier"))


def _positions(size: Column, names: int, *parts) -> Column:
    """``names`` distinct whole numbers of 1..size by Floyd's method, every draw the MD5 of the parts and its step."""

    steps = F.transform(F.sequence(size - (names - 1), size), lambda i: F.struct(i.alias("i"), (F.pmod(_as_number(_md5_draw(*parts, i)), i) + 1).alias("at")))

    def step(drawn: Column, s: Column) -> Column:
        return F.concat(drawn, F.array(F.when(F.array_contains(drawn, s["at"]), s["i"]).otherwise(s["at"])))

    return F.aggregate(steps, F.array().cast("array<bigint>"), step)


def random_sleeves(
    pools: DataFrame, trials: int = 1000, names: int = 20, seed: int = 42, large: bool | None = None
) -> DataFrame:
    """(tier, trial, date, ret): mean return of ``names`` drawn without replacement.

    Every pool is numbered once by entity and a trial draws positions, so the work is dates x trials x names
    however many rows a pool has. Pools have at least ``names`` rows."""
    places = held(numbered(pools, ["tier", "date"], ["entity"], "__at", "__size", large).select("tier", "date", "__at", "ret"))
    sizes = places.groupBy("tier", "date").agg(F.max("__at").alias("__size"))
    tasks = int(pools.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, much work: not to be merged
    every = sizes.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).repartition(tasks, "tier", "date", "trial")
    drawn = every.select("tier", "trial", "date", F.explode(_positions(F.col("__size"), names, F.lit(seed), "tier", "date", "trial")).alias("__at"))
    return drawn.join(places, ["tier", "date", "__at"]).groupBy("tier", "trial", "date").agg(F.avg("ret").alias("ret"))


def sleeve_paths(draws: DataFrame) -> DataFrame:
    """Equity after each date per (tier, trial), with the number of dates."""
    w = Window.partitionBy("tier", "trial").orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return draws.select(
        "tier", "trial", "date", F.product(1 + F.col("ret")).over(run).alias("equity"),
        F.count(F.lit(1)).over(Window.partitionBy("tier", "trial")).alias("n_dates"),
    )


def sleeve_distribution(paths: DataFrame, per_year: int = 4, min_dates: int = 4) -> DataFrame:
    """CAGR percentiles per tier and the share of trials above the unscreened median."""
    last = paths.groupBy("tier", "trial").agg(F.max_by("equity", "date").alias("e"), F.first("n_dates").alias("n"))
    cagr = last.where(F.col("n") >= min_dates).select(
        "tier", "trial", (F.pow("e", F.lit(float(per_year)) / F.col("n")) - 1).alias("cagr")
    )
    median = cagr.where(F.col("tier") == "full").agg(F.percentile("cagr", F.lit(0.5)).alias("__m"))
    j = cagr.join(F.broadcast(median), F.lit(True))
    return j.groupBy("tier").agg(
        *[F.percentile("cagr", F.lit(p / 100)).alias(f"p{p}") for p in PERCENTILES],
        F.avg("cagr").alias("mean"),
        F.avg((F.col("cagr") > F.col("__m")).cast("double")).alias("prob_beat_full_median"),
        F.count(F.lit(1)).alias("n_trials"),
    )


def equity_bands(paths: DataFrame) -> DataFrame:
    """Percentile bands of equity per tier and date."""
    return paths.groupBy("tier", "date").agg(
        *[F.percentile("equity", F.lit(p / 100)).alias(f"p{p}") for p in PERCENTILES]
    )


def _md5_draw(*parts) -> Column:
    """A hashed draw that any engine can repeat: the MD5 text of the parts; order by it, or read its first 8 digits as a number."""
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def _as_number(draw: Column) -> Column:
    return F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")


def permuted_scores(
    df: DataFrame, score: str, trials: int | Sequence[int] = 10, seed: int = 0, large: bool | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """(trial, date, entity, score) with the scores of each date dealt out again at random; ``carry`` stays with the entity.

    ``trials`` is how many there are, or the numbers of those wanted.

    Rows are numbered by entity and, per trial, by hash; the two numberings meet one to one. Dates that fit a task do so
    in the one shuffle that brings the rows of a (trial, date) together, the hash being made behind it."""
    base = cheap(df.select("date", "entity", F.col(score).alias("score"), *carry).where(F.col("date").isNotNull()), df)
    wanted = list(range(trials)) if isinstance(trials, int) else list(trials)
    every = F.explode(F.array(*[F.lit(t) for t in wanted]))
    draw = _md5_draw(F.lit(seed), "trial", "date", "entity")

    def steps(d: DataFrame, large: bool) -> DataFrame:
        holders = numbered(d, ["date"], ["entity"], "k", "n", large).drop("n").withColumn("trial", every)
        if large:
            dealt = numbered(d.drop(*carry).withColumn("trial", every).withColumn("__u", draw), ["trial", "date"], ["__u", "entity"], "k", "n", True)
            met = holders.drop("score").join(dealt.select("trial", "date", "k", "score"), ["trial", "date", "k"])
            return met.select("trial", "date", "entity", *carry, "score")
        w = Window.partitionBy("trial", "date")
        tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * len(wanted))  # about a group each: not to be merged
        placed = holders.repartition(tasks, "trial", "date").withColumn("__u", draw)
        placed = placed.withColumn("__to", F.row_number().over(w.orderBy("__u", "entity"))).drop("__u")
        kinds = {f.name: f.dataType for f in d.schema.fields}
        own = [F.col(c).alias(c) for c in ("entity", *carry)]
        none = [F.lit(None).cast(kinds[c]).alias(c) for c in ("entity", *carry)]
        holder = F.struct(F.col("k").cast("int").alias("k"), F.lit(0).alias("side"), *own, F.lit(None).cast(kinds["score"]).alias("score"))
        sides = F.explode(F.array(holder, F.struct(F.col("__to").alias("k"), F.lit(1).alias("side"), *none, F.col("score").alias("score"))))
        both = placed.select("trial", "date", sides.alias("__s")).select("trial", "date", "__s.*")
        got = F.lead("score").over(w.orderBy("k", "side"))  # a holder is followed by the score dealt to it
        return both.withColumn("score", got).where(F.col("side") == 0).select("trial", "date", "entity", *carry, "score")

    return sized(base, ["date"], large, steps)


def _dealt_correlations(rows: pa.Table, trials: Sequence[int], seed: int) -> pa.Table:
    """(trial, rho, n) of the rows (entity, s, y, key) of one date, sorted by entity: the rank correlation of scores dealt out again
    with the labels.

    Holders stand in the order of entities, scores in that of the MD5 of seed, trial and key; they meet one to one. A repeated
    entity holds the labels of all its rows."""
    n = rows.num_rows
    entity, keys = rows.column("entity").combine_chunks(), rows.column("key").combine_chunks().cast(pa.binary())
    has_s, has_y = (rows.column(c).is_valid().to_numpy() for c in ("s", "y"))
    codes = np.full(n, -1, np.int32)  # a score's place among the distinct ones
    codes[has_s] = np.unique(rows.column("s").drop_null().to_numpy(), return_inverse=True, equal_nan=True)[1]
    other = pc.fill_null(pc.not_equal(entity.slice(1), entity.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
    known, first = entity.is_valid().to_numpy(zero_copy_only=False), np.flatnonzero(np.r_[True, other])
    if len(first) == n:
        holder = label = np.flatnonzero(known & has_y)
    else:
        size = np.diff(np.r_[first, n])
        most = np.repeat(size, size)  # labels of the entity of a row
        holder = np.repeat(np.arange(n), most)
        label = np.repeat(np.repeat(first, size), most) + np.arange(len(holder)) - np.repeat(np.cumsum(most) - most, most)
        use = known[holder] & has_y[label]
        holder, label = holder[use], label[use]
    y = rows.column("y").to_numpy()[label]
    del entity, other, known, first, label
    all_ranks, rhos, counts = places(y), [], []
    for trial in trials:
        start, draws = f"{seed}|{trial}|".encode(), np.empty((2, n), np.uint64)  # the two halves of a digest sort as its text does
        for at in range(0, n, MD5_ROWS):
            some = keys.slice(at, MD5_ROWS).to_pylist()
            text = b"".join([hashlib.md5(start + k, usedforsecurity=False).digest() for k in some])
            draws[:, at : at + len(some)] = np.frombuffer(text, ">u8").reshape(-1, 2).T
        to = np.argsort(draws[0], kind="stable")
        if (np.diff(draws[0][to]) == 0).any():
            to = np.lexsort((draws[1], draws[0]))
        del draws
        dealt = codes[to][holder]
        del to
        there = dealt >= 0
        ranks = all_ranks if there.all() else places(y[there])
        dealt = dealt[there]
        ties = np.bincount(dealt)
        rhos.append(correlation((np.cumsum(ties) - (ties - 1) / 2.0)[dealt], ranks))
        counts.append(len(dealt))
    return pa.table({"trial": pa.array(trials, pa.int32()), "rho": pa.array(rhos, pa.float64()), "n": pa.array(counts, pa.int64())})


def placebo(
    df: DataFrame, score: str, label: str, trials: int = 10, seed: int = 0, tolerance: float = 0.03, min_rows: int = 10,
    large: bool | None = None,
) -> DataFrame:
    """One row: real IC against the mean IC of permuted scores, and whether the check passes.

    A date that fits a task as plain numbers is moved once, whatever the number of trials: its scores are dealt out and ranked
    where its rows lie. Larger dates take one trial after the other, so that only one of them lies on disk."""
    real = ic_series(df, {"real": score}, {"h": label}, min_rows, large=large).agg(F.avg("ic").alias("real_ic"))
    rows = cheap(df.select("date", "entity", F.round(score, 9).alias("s"), F.round(label, 9).alias("y")).where(F.col("date").isNotNull()), df)

    def steps(d: DataFrame, large: bool) -> DataFrame:
        if not large:
            key = F.concat_ws("|", F.col("date").cast("string"), F.col("entity").cast("string"))
            plain = d.withColumns({c: F.col(c).cast("double") for c in ("s", "y")})
            return per_date(plain, "date", partial(_dealt_correlations, trials=range(trials), seed=seed), "trial int, rho double, n bigint", ["entity"], key=key).drop("date")
        # a repeated entity of a date holds the labels of all its rows
        told = durable(d.select("date", "entity", "s", F.collect_list("y").over(Window.partitionBy("date", "entity")).alias("__y")))

        def turn(trial: int) -> DataFrame:
            shuffled = permuted_scores(told, "s", [trial], seed, True, ["__y"])
            pairs = shuffled.where(F.col("score").isNotNull() & F.col("entity").isNotNull()).select(
                "date", "entity", F.col("score").alias("s"), F.explode("__y").alias("y")
            )
            return rank_correlation(pairs, ["date"], large=True).select(F.lit(trial).alias("trial"), "rho", "n")

        return reduce(DataFrame.unionByName, [alone(df.sparkSession, partial(turn, t)) for t in range(trials)])

    per = sized(rows, ["date"], large, steps, HELD_ROWS).where((F.col("n") >= min_rows) & F.col("rho").isNotNull())
    means = per.groupBy("trial").agg(F.avg(-F.col("rho")).alias("m"))
    stat = means.agg(F.avg("m").alias("placebo_ic_mean"), F.stddev_pop("m").alias("placebo_ic_std"))
    both = real.join(F.broadcast(stat), F.lit(True))
    ok = (F.abs("placebo_ic_mean") < tolerance) & (F.col("real_ic") > F.col("placebo_ic_mean"))
    return both.withColumn("tolerance", F.lit(tolerance)).withColumn("passed", F.coalesce(ok, F.lit(False)))


def factor_masks(spark, factors: Sequence[str], draws: int = 100, seed: int = 7, least: int = 3) -> DataFrame:
    """(draw, picks): a random subset of at least ``least`` factor positions per draw."""
    p = len(factors)
    grid = spark.range(draws).select(
        F.col("id").cast("int").alias("draw"),
        (F.lit(least) + F.pmod(_as_number(_md5_draw(F.lit(seed), "id")), F.lit(p - least + 1))).cast("int").alias("__size"),
    )
    order = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(p - 1)),
            lambda i: F.struct(_md5_draw(F.lit(seed), "draw", i).alias("u"), i.cast("int").alias("i")),
        )
    )
    return grid.select("draw", F.transform(F.slice(order, 1, F.col("__size")), lambda x: x["i"]).alias("picks"))


def _nine_digits(v: np.ndarray) -> np.ndarray:
    """Rounded half up, as values are before every rank."""
    return np.copysign(np.floor(np.abs(v) * 1e9 + 0.5) / 1e9, v)


def _composite_correlations(rows: pa.Table, picks: Sequence[Sequence[int]]) -> pa.Table:
    """(k, rho, n) of the rows of one date: the rank correlation of the k-th composite with the label."""

    def column(c: str) -> np.ndarray:
        return rows.column(c).to_numpy(zero_copy_only=False)

    label, xs, have = column("y"), [], []
    for i in range(rows.num_columns - 1):
        present = rows.column(f"x{i}").is_valid().to_numpy(zero_copy_only=False)
        have.append(None if present.all() else present)
        xs.append(column(f"x{i}") if have[i] is None else np.where(present, column(f"x{i}"), 0.0))
    label_places, rhos, counts = places(label), [], []
    for chosen in picks:
        total, present = np.zeros(len(label)), np.zeros(len(label))
        for i in chosen:
            total += xs[i]
            present += 1 if have[i] is None else have[i]
        some = present > 0
        if some.all():
            at = label_places
        else:
            total, present, at = total[some], present[some], places(label[some])
        counts.append(len(total))
        rhos.append(correlation(places(_nine_digits(total / present)), at))
    return pa.table({"k": pa.array(range(len(picks)), pa.int32()), "rho": pa.array(rhos, pa.float64()), "n": pa.array(counts, pa.int64())})


def random_composites(
    df: DataFrame, factors: Sequence[str], label: str, masks: DataFrame, min_rows: int = 10, large: bool | None = None
) -> DataFrame:
    """(draw, mean_ic) of equal-weight composites of random factor subsets.

    The masks (draws x factors) travel to the rows. A date that fits a task as plain numbers is shuffled once, whatever the number
    of draws: its composites are built and ranked where its rows lie. Of larger dates, (draw, date) ranks are shuffled."""
    drawn = masks.select("draw", "picks").collect()  # a parameter: draws x factors numbers
    rows = df.where(F.col(label).isNotNull()).select(
        "date", "entity", F.round(label, 9).alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(factors)]
    )
    names = [f"x{i}" for i in range(len(factors))]

    def steps(d: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = _composites(d.select("date", "entity", "y", F.array(*names).alias("__x")), masks)
            return rank_correlation(pairs, ["draw", "date"], large=True).select("draw", "rho", "n")
        picks = [list(r["picks"]) for r in drawn]
        tasks = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), 128)  # about a date each: not to be merged
        placed = d.select("date", F.col("y").cast("double").alias("y"), *names).repartition(tasks, "date")
        found = placed.groupBy("date").applyInArrow(
            lambda t: _composite_correlations(t.select(["y", *names]), picks), "k int, rho double, n bigint"
        )
        numbers = F.array(*[F.lit(r["draw"]) for r in drawn])
        return found.select(F.element_at(numbers, F.col("k") + 1).alias("draw"), "rho", "n")

    if not drawn:
        return masks.select("draw", F.lit(None).cast("double").alias("mean_ic")).where(F.lit(False))
    per = sized(rows, ["date"], large, steps, HELD_ROWS).where((F.col("n") >= min_rows) & F.col("rho").isNotNull())
    return per.groupBy("draw").agg(F.avg(-F.col("rho")).alias("mean_ic"))


def _composites(rows: DataFrame, masks: DataFrame) -> DataFrame:
    """(draw, date, entity, s, y): every row (date, entity, y, __x) once a draw."""
    packed = masks.agg(F.collect_list(F.struct("draw", "picks")).alias("__masks"))  # one small row
    wide = rows.join(F.broadcast(packed), F.lit(True)).withColumn("__m", F.explode("__masks")).drop("__masks")
    chosen = F.filter(F.transform("__m.picks", lambda i: F.element_at("__x", i + 1)), lambda v: v.isNotNull())
    total = F.aggregate(chosen, F.lit(0.0), lambda a, v: a + v)
    z = F.round(F.try_divide(total, F.size(chosen).cast("double")), 9)
    return wide.select(F.col("__m.draw").alias("draw"), "date", "entity", z.alias("s"), "y").where(F.col("s").isNotNull())


def null_summary(null: DataFrame, real: DataFrame) -> DataFrame:
    """Where the real mean IC sits in the null distribution; ``real`` is one row with ``real_ic``."""
    j = null.join(F.broadcast(real), F.lit(True))
    return j.agg(
        F.count(F.lit(1)).alias("n_draws"),
        F.max("real_ic").alias("real_ic"),
        F.avg("mean_ic").alias("null_mean"),
        F.percentile("mean_ic", F.lit(0.95)).alias("null_p95"),
        F.avg((F.col("mean_ic") >= F.col("real_ic")).cast("double")).alias("p_value"),
    )
