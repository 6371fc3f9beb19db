"""Tables a reader looks at: ranked names, decompositions, transitions, holdings reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .calendar import comparison_dates, latest_cross_section, previous_cross_section, quarter_end_subset
from .peers import percentile_rank
from .ranking import numbered


def worst_first(latest: DataFrame, score: str, out: str = "sell_rank", large: bool | None = None) -> DataFrame:
    """Rank of one cross section, highest score first, ties by entity; NULL scores unranked."""
    d = latest.withColumn("__all", F.col(score).isNull()).withColumn("__neg", -F.round(score, 9))
    ranked = numbered(d, ["__all"], ["__neg", "entity"], out, "__n", large)
    return ranked.withColumn(out, F.when(~F.col("__all"), F.col(out))).drop("__all", "__neg", "__n")


def top_names(latest: DataFrame, score: str, k: int = 10) -> DataFrame:
    """The k worst names; Spark keeps only k rows per task."""
    return latest.where(F.col(score).isNotNull()).orderBy(F.round(score, 9).desc(), "entity").limit(k)


def with_previous(df: DataFrame, values: Sequence[str], days_back: int = 75) -> DataFrame:
    """Latest cross section with each value's reading about a quarter earlier as ``prev_<value>``."""
    latest, prev = latest_cross_section(df), previous_cross_section(df, days_back)
    prev = prev.select("entity", F.col("date").alias("prev_date"), *[F.col(v).alias(f"prev_{v}") for v in values])
    return latest.join(prev, "entity", "left")


def decomposition(
    df: DataFrame, factors: Sequence[str], group: Sequence[str] = ("sector",), days_back: int = 75,
    large: bool | None = None,
) -> DataFrame:
    """(entity, factor, raw, z, pct, prev_z) of the latest cross section; factors nobody filled are left out."""
    zs = [f"{f}__n" for f in factors]
    cur = with_previous(df, zs, days_back)
    parts = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("factor"), F.col(f).cast("double").alias("raw"), F.col(f"{f}__n").alias("z"),
                    F.col(f"prev_{f}__n").alias("prev_z"),
                )
                for f in factors
            ]
        )
    )
    long = cur.select("entity", *group, parts.alias("p")).select("entity", *group, "p.*")
    ranked = percentile_rank(long, "z", "pct", [*group, "factor"], scale=100.0, large=large)
    return ranked.where(F.col("raw").isNotNull() | F.col("z").isNotNull())


def last_event(points: DataFrame, events: DataFrame, day: str, out: str = "last_print") -> DataFrame:
    """Newest event at or before the date of each row of one cross section."""
    at = points.agg(F.max("date").alias("__at"))
    seen = events.join(F.broadcast(at), F.col(day) <= F.col("__at")).groupBy("entity").agg(F.max(day).alias(out))
    return points.join(seen, "entity", "left")


def top_flags(long: DataFrame, k: int = 3, above: float = float("-inf")) -> DataFrame:
    """The k strongest factors per name above a floor; a name has as many rows as factors."""
    w = Window.partitionBy("entity").orderBy(F.round("z", 9).desc(), "factor")
    return (
        long.where(F.col("z").isNotNull() & (F.col("z") > above)).withColumn("flag_no", F.row_number().over(w)).where(F.col("flag_no") <= k)
    )


def risk_drivers(long: DataFrame, cut: float = 0.5, reds: int = 3, greens: int = 2) -> DataFrame:
    """Strongest warnings (z >= cut) and offsets (z <= -cut) per name."""
    red = Window.partitionBy("entity").orderBy(F.round("z", 9).desc(), "factor")
    green = Window.partitionBy("entity").orderBy(F.round("z", 9).asc(), "factor")
    d = long.where(F.col("z").isNotNull()).select(
        "entity", "factor", "z", F.row_number().over(red).alias("r"), F.row_number().over(green).alias("g")
    )
    side = F.when((F.col("z") >= cut) & (F.col("r") <= reds), "red").when((F.col("z") <= -cut) & (F.col("g") <= greens), "green")
    place = F.when(F.col("z") >= cut, F.col("r")).otherwise(F.col("g"))
    return d.select("entity", "factor", "z", side.alias("side"), place.alias("place")).where(F.col("side").isNotNull())


def base_rate(era_ic: DataFrame, study: DataFrame, least: int = 12) -> DataFrame:
    """Inputs of the base-rate sentence: gate on full-factor periods, then the entrant path's end."""
    gate = era_ic.agg(F.coalesce(F.max(F.when(F.col("era") == "full factor", F.col("n_periods"))), F.lit(0)).alias("era_periods"))
    path = study.where(F.col("cohort") == "entrant").agg(
        F.max_by("cum_mean", "k").alias("cum"), F.count(F.lit(1)).alias("n_quarters"), F.min_by("n", "k").alias("n")
    )
    j = gate.join(F.broadcast(path), F.lit(True))
    ok = F.col("era_periods") >= least
    return j.select(
        F.col("era_periods").cast("long").alias("era_periods"), ok.alias("shown"), F.when(ok, F.col("cum")).alias("cum_mean"),
        "n_quarters", "n",
    )


def sector_deciles(latest: DataFrame, decile: str = "decile", sector: str = "sector") -> DataFrame:
    return latest.where(F.col(decile).isNotNull()).groupBy(sector, F.col(decile).alias("decile")).agg(F.count(F.lit(1)).alias("n"))


def worst_names(latest: DataFrame, decile: str = "decile", sector: str = "sector", worst: int = 10) -> DataFrame:
    """Names of the worst bucket per sector, one row per name in reading order.

    Kept as rows: a list per sector would grow with the universe inside one cell."""
    w = latest.where(F.col(decile) == worst).select(sector, "entity")
    ranked = numbered(w, [sector], ["entity"], "place", "n_names")
    return ranked


def tier_counts(latest: DataFrame, tier: str = "risk_tier", pct: str = "risk_pct") -> DataFrame:
    return latest.where(F.col(pct).isNotNull()).groupBy(tier).agg(F.count(F.lit(1)).alias("n"))


def latest_risk(df: DataFrame, pct: str = "risk_pct", large: bool | None = None) -> DataFrame:
    """Latest cross section ranked by absolute risk, high to low."""
    return worst_first(latest_cross_section(df).where(F.col(pct).isNotNull()), pct, "risk_rank", large)


def decile_steps(df: DataFrame, decile: str) -> DataFrame:
    """(entity, date, from_decile, to_decile) for entities scored on two consecutive quarter ends."""
    d = quarter_end_subset(df).where(F.col(decile).isNotNull()).select("entity", "date", F.col(decile).cast("int").alias("d"))
    dates = d.select("date").distinct()
    cal = dates.select("date", F.row_number().over(Window.orderBy("date")).alias("__i"))
    d = d.join(F.broadcast(cal), "date")
    w = Window.partitionBy("entity").orderBy("__i")
    step = F.when(F.lead("__i").over(w) == F.col("__i") + 1, F.lead("d").over(w))
    return d.select("entity", "date", F.col("d").alias("from_decile"), step.alias("to_decile")).where(F.col("to_decile").isNotNull())


def transition_matrix(df: DataFrame, decile: str, buckets: int = 10) -> DataFrame:
    """Full N x N counts and row probabilities; an empty row has probability 0."""
    counts = decile_steps(df, decile).groupBy("from_decile", "to_decile").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(1, buckets + 1).select(
        F.col("id").cast("int").alias("from_decile"), F.explode(F.sequence(F.lit(1), F.lit(buckets))).alias("to_decile")
    )
    full = grid.join(counts, ["from_decile", "to_decile"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.sum("n").over(Window.partitionBy("from_decile"))
    return full.withColumn("row_prob", F.coalesce(F.try_divide("n", total), F.lit(0.0)).cast("double"))


def flag_churn(df: DataFrame, decile: str, buckets: int = 10) -> DataFrame:
    """Names newly in, or gone from, the two worst buckets between the last two quarter ends.

    A name with no reading now has not "exited"."""
    q = quarter_end_subset(df).where(F.col(decile).isNotNull())
    dates = q.select("date").distinct()
    last = dates.select(F.max("date").alias("cur")).join(F.broadcast(dates), F.lit(True))
    pair = last.groupBy("cur").agg(F.max(F.when(F.col("date") < F.col("cur"), F.col("date"))).alias("prev"))
    tagged = q.join(F.broadcast(pair), (F.col("date") == F.col("cur")) | (F.col("date") == F.col("prev")))
    per = tagged.groupBy("entity").agg(
        F.max(F.when(F.col("date") == F.col("cur"), F.col("sector"))).alias("sector"),
        F.max(F.when(F.col("date") == F.col("cur"), F.col(decile))).alias("decile"),
        F.max(F.when(F.col("date") == F.col("prev"), F.col(decile))).alias("prev_decile"),
        F.max("prev").alias("__prev"),
    ).where(F.col("__prev").isNotNull()).drop("__prev")
    bad = buckets - 1
    new = (F.col("decile") >= bad) & (F.col("prev_decile").isNull() | (F.col("prev_decile") < bad))
    gone = (F.col("prev_decile") >= bad) & (F.col("decile") < bad)
    return per.withColumn("change", F.when(new, "newly_flagged").when(gone, "exited")).where(F.col("change").isNotNull())


def exclusion_summary(log: DataFrame) -> DataFrame:
    """Excluded labels and distinct entities per reason."""
    return log.groupBy("reason").agg(F.count(F.lit(1)).alias("n_labels"), F.countDistinct("entity").alias("n_entities"))


def holdings_review(latest: DataFrame, holdings: DataFrame, overrides: DataFrame | None = None, buckets: int = 10) -> DataFrame:
    """One row per holding: bucket, change, NEW, DOUBLE, REVIEW and the number of active overrides."""
    bad = buckets - 1
    j = holdings.join(latest.select("entity", "sector", "score", "decile", "prev_decile", "risk_tier", F.lit(True).alias("__in")), "entity", "left")
    d = F.coalesce("decile", F.lit(0))
    out = j.select(
        "entity",
        F.coalesce("__in", F.lit(False)).alias("in_universe"),
        "sector",
        "score",
        "decile",
        (F.col("decile") - F.col("prev_decile")).alias("change"),
        (F.col("__in").isNotNull() & (d >= bad) & (F.col("prev_decile").isNull() | (F.col("prev_decile") < bad))).alias("is_new"),
        ((d >= bad) & F.coalesce(F.col("risk_tier") == "Elevated", F.lit(False))).alias("is_double"),
        (d == buckets).alias("is_review"),
    )
    if overrides is None:
        return out.withColumn("n_overrides", F.lit(0).cast("long"))
    active = overrides.groupBy("entity").agg(F.count(F.lit(1)).alias("__o"))
    return out.join(active, "entity", "left").withColumn("n_overrides", F.coalesce("__o", F.lit(0)).cast("long")).drop("__o")


def overlay_summary(review: DataFrame) -> DataFrame:
    """KPI row over the holdings found in the universe."""
    held = review.where(F.col("in_universe"))
    flag = lambda c: F.count(F.when(F.col(c), 1))
    return held.agg(
        F.count(F.lit(1)).alias("matched"), flag("is_review").alias("in_worst"), flag("is_new").alias("newly_flagged"),
        flag("is_double").alias("double_flagged"), F.coalesce(F.avg(F.coalesce("decile", F.lit(0))), F.lit(0.0)).alias("mean_decile"),
    )


def contrast(latest: DataFrame, index_name: str | None = None) -> DataFrame:
    """Names with both scores, in the chosen universe, and whether both lenses agree on trouble."""
    d = latest.where(F.col("score").isNotNull() & F.col("risk_pct").isNotNull())
    if index_name:
        d = d.where(F.col("index_name") == index_name)
    return d.withColumn("double_trouble", (F.col("decile") >= 9) & (F.col("risk_pct") >= 70))


def cohort_paths(
    cohort: DataFrame, bars: DataFrame, calendar: DataFrame, mkt: DataFrame | None, horizon: int, step: int = 5
) -> DataFrame:
    """Cumulative (benchmark-adjusted) return paths of a cohort, every ``step`` sessions and the last.

    ``cohort`` is (entity, decile, base_no); names need a positive price on the base session
    and at least two points."""
    base = cohort.join(bars.select("entity", F.col("session_no").alias("base_no"), F.col("close").alias("p0")), ["entity", "base_no"])
    base = base.where(F.col("p0") > 0)
    px = bars.where(F.col("close").isNotNull()).select("entity", "session_no", "date", "close")
    j = base.join(px, "entity").where(F.col("session_no").between(F.col("base_no"), F.col("base_no") + horizon))
    j = j.withColumn("__k", F.col("session_no") - F.col("base_no")).where((F.col("__k") % step == 0) | (F.col("__k") == horizon))
    value = F.col("close") / F.col("p0") - 1
    if mkt is not None:
        m = mkt.select("session_no", "mkt_close")
        m0 = m.select(F.col("session_no").alias("base_no"), F.col("mkt_close").alias("m0"))
        j = j.join(F.broadcast(m), "session_no", "left").join(F.broadcast(m0), "base_no", "left")
        value = F.when(F.col("m0") > 0, value - (F.col("mkt_close") / F.col("m0") - 1)).otherwise(value)
    n = F.count(F.lit(1)).over(Window.partitionBy("entity", "base_no"))
    group = F.when(F.col("decile") >= 9, "bottom").otherwise("top")
    return j.withColumn("v", value).withColumn("__n", n).where((F.col("__n") >= 2) & F.col("v").isNotNull()).select(
        "entity", "decile", group.alias("side"), "date", "v"
    )


def cohort_median(paths: DataFrame, large: bool | None = None) -> DataFrame:
    """Upper median (element n/2 of the sorted values) of each side per date."""
    d = paths.withColumn("__v", F.round("v", 9))
    ranked = numbered(d, ["side", "date"], ["__v", "entity"], "__k", "__n", large)
    pick = F.col("__k") == F.floor(F.col("__n") / 2) + 1
    return ranked.groupBy("side", "date").agg(F.max(F.when(pick, F.col("v"))).alias("median_v"), F.max("__n").alias("n"))


def last_graded_date(dates: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """Newest date (with its session number) whose whole horizon has been traded; one row."""
    end = calendar.agg(F.max("session_no").alias("__end"))
    j = dates.select("date").distinct().join(calendar, "date").join(F.broadcast(end), F.lit(True))
    return j.where(F.col("session_no") + horizon <= F.col("__end")).agg(
        F.max("date").alias("date"), F.max("session_no").alias("base_no")
    )


def run_summary(df: DataFrame, bars: DataFrame) -> DataFrame:
    """One line about a run: dates, sizes, carried labels."""
    last = latest_cross_section(df).agg(F.countDistinct("entity").alias("universe_size"), F.countDistinct("sector").alias("n_sectors"))
    all_ = df.agg(
        F.max("date").alias("latest_date"), F.countDistinct("date").alias("n_cross_sections"), F.count(F.lit(1)).alias("panel_rows"),
        F.count(F.when(F.col("delisted"), 1)).alias("n_delisted"),
    )
    px = bars.agg(F.max("date").alias("prices_through"))
    return all_.join(F.broadcast(last), F.lit(True)).join(F.broadcast(px), F.lit(True))


def universe_floor(latest: DataFrame, floor: int) -> DataFrame:
    """Refuse to publish a cross section that lost names."""
    return latest.agg(F.countDistinct("entity").alias("n_names")).withColumn("passed", F.col("n_names") >= floor)
