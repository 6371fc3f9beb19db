"""Point-in-time lookups: as-of, interval, carried and offset joins.

As-of joins are one union and one window per entity. Both inputs are first collapsed to
one row per (entity, day), so a window partition is bounded by the calendar even when one
entity owns a large share of the raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOREVER = "9999-12-31"


def latest_per_day(facts: DataFrame, day: str, order: Sequence[str], values: Sequence[str], entity: str = "entity"):
    """One row per (entity, day): the row greatest in ``order``, then in its values, so that ties give the same row on
    every run; combined before the shuffle."""
    if not values:
        return facts.select(entity, day).distinct()
    row = F.struct(*[F.col(v) for v in values])
    key = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate([*order, *values])])
    picked = facts.groupBy(entity, day).agg(F.max_by(row, key).alias("__r"))
    return picked.select(entity, day, *[F.col("__r")[v].alias(v) for v in values])


def asof_join(
    points: DataFrame, facts: DataFrame, at: str = "date", known: str = "as_of", values: Sequence[str] = (),
    tie_break: Sequence[str] = (), entity: str = "entity",
) -> DataFrame:
    """Newest fact with ``known <= at`` per point, as one whole row (its NULLs too), plus ``known``.

    ``points`` may repeat (entity, at): each distinct pair is looked up once and joined back
    only when it carries other columns."""
    one = latest_per_day(facts.where(F.col(known).isNotNull()), known, tie_break, values, entity)
    src = one.select(
        entity, F.col(known).alias("__t"), F.lit(0).alias("__k"), F.struct(F.col(known), *values).alias("__f")
    )
    shape = src.schema["__f"].dataType
    pts = points.select(entity, at).distinct().select(
        entity, F.col(at).alias("__t"), F.lit(1).alias("__k"), F.lit(None).cast(shape).alias("__f")
    )
    w = Window.partitionBy(entity).orderBy("__t", "__k").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        src.unionByName(pts)
        .withColumn("__l", F.last("__f", ignorenulls=True).over(w))
        .where(F.col("__k") == 1)
        .select(entity, F.col("__t").alias(at), "__l.*")
    )
    if set(points.columns) == {entity, at}:
        return found
    return points.join(found, [entity, at], "left")


def asof_price(points: DataFrame, bars: DataFrame, at: str = "date", entity: str = "entity") -> DataFrame:
    """Last present close at or before each point."""
    px = bars.where(F.col("close").isNotNull()).select(entity, F.col("date").alias("as_of"), "close")
    return asof_join(points, px, at, "as_of", ["close"], entity=entity)


def sample_exact_then_carry(daily: DataFrame, dates: DataFrame, values: Sequence[str]) -> DataFrame:
    """Exact values on the given dates; dates past the feed's end take its last day's row.

    NULLs inside the feed stay NULL: they were put there on purpose."""
    end = daily.agg(F.max("date").alias("__end"))
    wanted = dates.select("date").join(F.broadcast(end), F.lit(True)).select(
        F.col("date").alias("at"), F.least("date", "__end").alias("date")
    )
    return daily.join(F.broadcast(wanted), "date").select("entity", F.col("at").alias("date"), *values)


def has_history(membership: DataFrame) -> DataFrame:
    """One row, one flag: does the store look like real history rather than one snapshot?"""
    note = F.coalesce(F.trim("delist_note"), F.lit("")) != ""
    return membership.agg(
        F.coalesce(
            (F.min("start_date") != F.max("start_date"))
            | F.bool_or(F.col("end_date").isNotNull())
            | F.bool_or(note),
            F.lit(False),
        ).alias("point_in_time")
    )


def members_on(membership: DataFrame, dates: DataFrame, respect_history: bool = True) -> DataFrame:
    """(date, entity, company, sector): membership valid on each date.

    ``dates`` is a rebalance calendar (one row per date). An interval is cut into the months it covers inside
    the calendar and meets the dates of those months by an equi join, so no interval is held against
    dates far from it. A store without history is taken as today's members for every date, end dates still honoured.
    Overlapping intervals of one entity give one row: the earliest start."""
    one_row = has_history(membership).join(F.broadcast(dates.agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"))), F.lit(True))
    m = membership.join(F.broadcast(one_row), F.lit(True))
    begin = F.col("start_date")
    if respect_history:
        begin = F.when(F.col("point_in_time"), begin).otherwise(F.col("__lo"))
    # greatest and least skip NULL, so a missing start must go first
    m = m.withColumn("__from", F.when(begin.isNotNull(), F.greatest(begin, "__lo"))).withColumn(
        "__to", F.least(F.coalesce("end_date", F.lit(FOREVER).cast("date")), F.col("__hi"))
    ).where(F.col("__from") <= F.col("__to"))
    months = F.sequence(F.trunc("__from", "month"), F.trunc("__to", "month"), F.expr("interval 1 month"))
    by_month = dates.select("date", F.trunc("date", "month").alias("__month"))
    hit = m.withColumn("__month", F.explode(months)).join(F.broadcast(by_month), "__month").where(F.col("date").between(F.col("__from"), F.col("__to")))
    one = hit.groupBy("date", "entity").agg(
        F.min_by(F.struct("company", "sector"), F.struct("start_date", "sector", "company")).alias("__m")
    )
    return one.select("date", "entity", "__m.company", "__m.sector")


def latest_known_sector(membership: DataFrame) -> DataFrame:
    """Newest present value per column for every entity that was ever a member."""

    def newest(c: str):
        return F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("start_date", c)))

    return membership.groupBy("entity").agg(newest("company").alias("company"), newest("sector").alias("sector"))


def label_members(members: DataFrame, labels: DataFrame, default: str, out: str = "index_name") -> DataFrame:
    """Left join of a label dimension with a default."""
    dim = labels.select("entity", F.col("index_name").alias("__l"))
    return members.join(dim, "entity", "left").withColumn(out, F.coalesce("__l", F.lit(default))).drop("__l")


def prefer_primary(primary: DataFrame, fallback: DataFrame, entity: str = "entity") -> DataFrame:
    """All primary rows, plus fallback rows of entities the primary source does not have."""
    have = primary.select(entity).distinct()
    return primary.unionByName(fallback.join(have, entity, "left_anti"), allowMissingColumns=True)


def spans_event(windows: DataFrame, events: DataFrame, start: str, end: str, day: str, out: str) -> DataFrame:
    """Flag windows (start, end] that contain an event day of the same entity.

    Both sides carry a day number; events of an entity become one sorted running value, so no
    pairs are formed: the newest event at or before ``end`` must be later than ``start``."""
    found = asof_join(
        windows.select("entity", F.col(end).alias("__end")).distinct(),
        events.select("entity", F.col(day).alias("__ev")).distinct(),
        "__end", "__ev", [], [],
    )
    j = windows.withColumn("__end", F.col(end)).join(found, ["entity", "__end"], "left")
    return j.withColumn(out, F.coalesce(F.col("__ev") > F.col(start), F.lit(False))).drop("__end", "__ev")


def active_on(overrides: DataFrame, day: str) -> DataFrame:
    """Entries filed on or before a day and not yet expired."""
    d = F.lit(day).cast("date")
    return overrides.where((F.col("date") <= d) & (F.col("expires") >= d))


def benchmark_period_returns(bench: DataFrame, dates: DataFrame) -> DataFrame:
    """Benchmark return from each date to the next one, carried price; the last date has none."""
    one = F.lit("__bench")
    pts = dates.select("date").distinct().withColumn("entity", one)
    px = bench.where(F.col("close").isNotNull()).select(one.alias("entity"), F.col("date").alias("as_of"), "close")
    sampled = asof_join(pts, px, "date", "as_of", ["close"])
    w = Window.partitionBy("entity").orderBy("date")
    nxt = F.lead("close").over(w)
    return sampled.select("date", (F.try_divide(nxt, "close") - 1).alias("bench_ret"), F.lead("date").over(w).alias("__n")).where(
        F.col("__n").isNotNull()
    ).drop("__n")
