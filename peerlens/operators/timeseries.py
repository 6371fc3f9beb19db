"""Trailing features per entity, counted on the session calendar.

Bars are unique per (entity, session), so an entity window is bounded by the length of
the calendar however large the table. Frames run over ``session_no`` ranges: a missing
session uses up its slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.scalar import EPS
from .calendar import next_session


def by_session(entity: str = "entity") -> WindowSpec:
    return Window.partitionBy(entity).orderBy("session_no")


def at_offset(value: str | Column, k: int, entity: str = "entity") -> Column:
    """Value exactly ``k`` sessions away (negative = earlier); NULL when that session is missing."""
    c = F.col(value) if isinstance(value, str) else value
    return F.max(c).over(by_session(entity).rangeBetween(k, k))


def gated(agg: Column, value: str | Column, w: WindowSpec, least: int) -> Column:
    """A windowed aggregate, present only where at least ``least`` values are."""
    return F.when(F.count(value).over(w) >= least, agg)


def trailing(n: int, entity: str = "entity") -> WindowSpec:
    return by_session(entity).rangeBetween(-(n - 1), 0)


def dense_grid(bars: DataFrame, calendar: DataFrame, values: Sequence[str] = ("close", "volume")) -> DataFrame:
    """Every (entity, session) pair, with NULL where the entity did not trade.

    Each entity carries its sessions as one sequence that is exploded in place, so the grid
    needs no join of all pairs; its size is entities x sessions by definition."""
    span = calendar.agg(F.min("session_no").alias("lo"), F.max("session_no").alias("hi"))
    ents = bars.select("entity").distinct()
    grid = ents.join(F.broadcast(span), F.lit(True)).select(
        "entity", F.explode(F.sequence("lo", "hi")).alias("session_no")
    )
    grid = grid.join(F.broadcast(calendar), "session_no")
    return grid.join(bars.select("entity", "session_no", *values), ["entity", "session_no"], "left")


def session_returns(grid: DataFrame, out: str = "ret", pad: bool = True) -> DataFrame:
    """Return per session. ``pad`` carries the last close over gaps first (a gap gives 0, the
    jump comes on return); without it a gap gives NULL on both sides."""
    w = by_session()
    if not pad:
        return grid.withColumn(out, F.try_divide("close", at_offset("close", -1)) - 1)
    filled = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return grid.withColumn(out, F.try_divide(filled, before) - 1)


def market_returns(bench: DataFrame, calendar: DataFrame) -> DataFrame:
    """(session_no, mkt): forward-filled benchmark change on the calendar; one row per session."""
    b = calendar.join(bench.select("date", F.col("close").alias("__b")), "date", "left")
    w = Window.orderBy("session_no")
    filled = F.last("__b", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("__f", filled).select(
        "session_no", "__f", (F.try_divide("__f", F.lag("__f").over(w)) - 1).alias("mkt")
    ).withColumnRenamed("__f", "mkt_close")


def market_moments(mkt: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Rolling mean and population variance of the market, per window; one row per session."""
    w = Window.orderBy("session_no")
    cols = []
    for n in windows:
        f = w.rowsBetween(-(n - 1), 0)
        cols.append(gated(F.avg("mkt").over(f), "mkt", f, n).alias(f"m_mean_{n}"))
        cols.append(gated(F.var_pop("mkt").over(f), "mkt", f, n).alias(f"m_var_{n}"))
    return mkt.select("session_no", "mkt", *cols)


def price_features(
    grid: DataFrame, mkt: DataFrame | None = None, month: int = 21, quarter: int = 63, year: int = 252,
    keep: Sequence[str] = (),
) -> DataFrame:
    """All price features per (entity, session) on a dense grid with ``ret``: one window pass."""
    wm, wq, wy = trailing(month), trailing(quarter), trailing(year)
    price = {
        "mom_12_1": F.try_divide(at_offset("close", -month), at_offset("close", -year)) - 1,
        "reversal_1m": F.try_divide(F.col("close"), at_offset("close", -month)) - 1,
        "high_52w": F.try_divide("close", gated(F.max("close").over(wy), "close", wy, year)),
        "max_ret_1m": gated(F.max("ret").over(wm), "ret", wm, month),
    }
    df = grid
    out = dict(price)
    if mkt is not None:
        df = df.join(F.broadcast(market_moments(mkt, [quarter, year])), "session_no", "left")
        df = df.withColumn("__xm", F.col("ret") * F.col("mkt"))

        def beta(n: int, w: WindowSpec) -> Column:
            cov = gated(F.avg("__xm").over(w), "__xm", w, n) - gated(F.avg("ret").over(w), "ret", w, n) * F.col(
                f"m_mean_{n}"
            )
            return F.when(F.col(f"m_var_{n}") > EPS, cov / F.col(f"m_var_{n}"))

        out["beta_252d"] = beta(year, wy)
        spread = gated(F.var_pop("ret").over(wq), "ret", wq, quarter)
        b63 = beta(quarter, wq)
        out["ivol_63d"] = F.sqrt(F.greatest(spread - b63 * b63 * F.col(f"m_var_{quarter}"), spread * 0.0))
        null_if_unknown = spread.isNull() | b63.isNull()
        out["ivol_63d"] = F.when(~null_if_unknown, out["ivol_63d"])
    if "volume" in df.columns:
        dollar = F.col("close") * F.col("volume")
        df = df.withColumn("__illiq", F.when(dollar != 0, F.abs("ret") / dollar))
        out["amihud_63d"] = gated(F.avg("__illiq").over(wq), "__illiq", wq, month) * 1e9
    return df.select("entity", "date", "session_no", *keep, *[c.alias(n) for n, c in out.items()])


def price_features_at(
    bars: DataFrame, points: DataFrame, mkt: DataFrame | None = None, month: int = 21, quarter: int = 63, year: int = 252
) -> DataFrame:
    """Price features at (entity, session_no) points, each the last known by then: what ``price_features`` and
    ``carry_forward`` give on a dense grid, without the grid.

    Rows are the observed closes, the points, the session a month after each close, where momentum may be known, and the
    last session at which it is still in a quarter's window, where the illiquidity mean may be known for the last time. A session without a close has return 0 once an entity has
    started, so sums over a window need only its closes, and the count of returns is the distance to the start. The market
    (``mkt``) must move within every window; where it stands still the last beta before is not looked for."""
    seen = bars.where(F.col("close").isNotNull())
    cols = ["entity", "session_no", "close", *(["volume"] if "volume" in bars.columns else [])]
    none = [F.lit(None).cast(bars.schema[c].dataType).alias(c) for c in cols[2:]]
    end = bars.agg(F.max("session_no").alias("__end"))
    later = F.explode(F.array(F.col("session_no") + month, F.col("session_no") + (quarter - 1)))
    last = seen.select("entity", later.alias("session_no")).join(F.broadcast(end), F.col("session_no") <= F.col("__end"))
    rows = (
        seen.select(*cols, F.lit(0).alias("__point"))
        .unionByName(points.select("entity", "session_no", *none, F.lit(1).alias("__point")))
        .unionByName(last.select("entity", "session_no", *none, F.lit(0).alias("__point")))
        .repartition("entity")  # the sums below and all windows keep this one exchange
        .groupBy("entity", "session_no").agg(*[F.max(c).alias(c) for c in cols[2:]], F.max("__point").alias("__point"))
    )
    w, wm, wq, wy = by_session(), trailing(month), trailing(quarter), trailing(year)
    before = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min(F.when(F.col("close").isNotNull(), F.col("session_no"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = rows.withColumn("ret", F.when(F.col("close").isNotNull(), F.try_divide("close", before) - 1)).withColumn("__age", F.col("session_no") - first)

    def known(value: Column, n: int) -> Column:
        return F.when(F.col("__age") >= n, value)

    highest = F.greatest(F.max("ret").over(wm), F.when(F.count("ret").over(wm) < month, F.lit(0.0)))
    out = {
        "mom_12_1": F.try_divide(at_offset("close", -month), at_offset("close", -year)) - 1,
        "reversal_1m": F.try_divide(F.col("close"), at_offset("close", -month)) - 1,
        "high_52w": F.try_divide("close", gated(F.max("close").over(wy), "close", wy, year)),
        "max_ret_1m": known(highest, month),
    }
    if mkt is not None:
        df = df.join(F.broadcast(market_moments(mkt, [quarter, year])), "session_no", "left")
        df = df.withColumn("__xm", F.col("ret") * F.col("mkt")).withColumn("__rr", F.col("ret") * F.col("ret"))

        def mean(c: str, n: int, over: WindowSpec) -> Column:
            return F.coalesce(F.sum(c).over(over), F.lit(0.0)) / n

        def beta(n: int, over: WindowSpec) -> Column:
            cov = mean("__xm", n, over) - mean("ret", n, over) * F.col(f"m_mean_{n}")
            return known(F.when(F.col(f"m_var_{n}") > EPS, cov / F.col(f"m_var_{n}")), n)

        out["beta_252d"] = beta(year, wy)
        spread = known(mean("__rr", quarter, wq) - mean("ret", quarter, wq) * mean("ret", quarter, wq), quarter)
        rest = spread - beta(quarter, wq) * beta(quarter, wq) * F.col(f"m_var_{quarter}")
        out["ivol_63d"] = F.when(rest.isNotNull(), F.sqrt(F.greatest(rest, F.lit(0.0))))
    if "volume" in cols:
        dollar = F.col("close") * F.col("volume")
        df = df.withColumn("__illiq", F.when(dollar != 0, F.abs("ret") / dollar))
        out["amihud_63d"] = gated(F.avg("__illiq").over(wq), "__illiq", wq, month) * 1e9
    df = df.select("entity", "session_no", "__point", *[c.alias(n) for n, c in out.items()])
    carried = [F.last(n, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in out]
    return df.select("entity", "session_no", "__point", *carried).where(F.col("__point") == 1).drop("__point")


def short_flow_features(ratio_grid: DataFrame, window: int = 63, least: int = 21) -> DataFrame:
    """Trailing mean of a daily share and its change one window earlier; missing days stay missing."""
    w = trailing(window)
    level = ratio_grid.withColumn("short_vol_ratio", gated(F.avg("ratio").over(w), "ratio", w, least))
    return level.withColumn(
        "short_vol_chg", F.col("short_vol_ratio") - at_offset("short_vol_ratio", -window)
    )


def flow_ratio(flow: DataFrame) -> DataFrame:
    """Daily share of a flow, rows with a positive total only."""
    return flow.where(F.col("total_vol") > 0).withColumn("ratio", F.col("short_vol") / F.col("total_vol"))


def net_purchase_ratio(
    flow: DataFrame, calendar: DataFrame, window: int = 126, least: int = 63, start: str | None = None
) -> DataFrame:
    """(buys - sells) / (buys + sells) over a trailing window on a zero-filled grid.

    Filing days snap to the next session; the grid runs from the history start to the last
    filing session; NULL where nothing was traded in the window."""
    snapped = next_session(flow, calendar, "date", "__s").groupBy("entity", F.col("__s").alias("session_no")).agg(
        F.sum("buy_shares").alias("buy_shares"), F.sum("sell_shares").alias("sell_shares")
    )
    cal = calendar if start is None else calendar.where(F.col("date") >= F.lit(start).cast("date"))
    first = cal.agg(F.min("session_no").alias("lo"))
    span = snapped.agg(F.max("session_no").alias("hi")).join(first, F.lit(True))
    grid = (
        snapped.select("entity").distinct().join(F.broadcast(span), F.lit(True))
        .select("entity", "lo", F.explode(F.sequence("lo", "hi")).alias("session_no"))
    )
    full = grid.join(snapped, ["entity", "session_no"], "left")
    w = trailing(window)
    b = F.sum(F.coalesce("buy_shares", F.lit(0.0))).over(w)
    s = F.sum(F.coalesce("sell_shares", F.lit(0.0))).over(w)
    seen = F.col("session_no") - F.col("lo") + 1
    out = full.select("entity", "session_no", "lo", b.alias("__b"), s.alias("__s"), seen.alias("__n"))
    gross = F.col("__b") + F.col("__s")
    npr = F.when((F.col("__n") >= least) & (gross > 0), (F.col("__b") - F.col("__s")) / gross)
    return out.select("entity", "session_no", npr.alias("insider_npr_6m")).join(F.broadcast(calendar), "session_no")


def event_reactions(events: DataFrame, bars: DataFrame, calendar: DataFrame, mkt: DataFrame) -> DataFrame:
    """Abnormal move around each event, stamped at the session after the reaction session.

    ``mkt`` carries ``mkt_close`` per session. One row per (entity, stamped session); later
    events win."""
    ev = next_session(events, calendar, "reaction_date", "r0").select("entity", "reaction_date", "r0")
    px = bars.select("entity", "session_no", "close")
    b = F.broadcast(mkt.select("session_no", "mkt_close"))
    j = (
        ev.join(px.select("entity", (F.col("session_no") + 1).alias("r0"), F.col("close").alias("p0")), ["entity", "r0"])
        .join(px.select("entity", (F.col("session_no") - 1).alias("r0"), F.col("close").alias("p1")), ["entity", "r0"])
        .join(b.select((F.col("session_no") + 1).alias("r0"), F.col("mkt_close").alias("b0")), "r0")
        .join(b.select((F.col("session_no") - 1).alias("r0"), F.col("mkt_close").alias("b1")), "r0")
        .where((F.col("p0") > 0) & (F.col("b0") > 0) & F.col("p1").isNotNull() & F.col("b1").isNotNull())
    )
    move = (F.col("p1") / F.col("p0") - 1) - (F.col("b1") / F.col("b0") - 1)
    return (
        j.select("entity", (F.col("r0") + 1).alias("session_no"), "reaction_date", move.alias("move"))
        .groupBy("entity", "session_no")
        .agg(F.max_by("move", "reaction_date").alias("reaction"))
    )


def latest_reaction(reactions: DataFrame, points: DataFrame, expiry: int = 70) -> DataFrame:
    """Newest reaction known at each (entity, session_no) point, gone after ``expiry`` sessions."""
    src = reactions.select("entity", "session_no", "reaction", F.lit(0).alias("__k"))
    pts = points.select("entity", "session_no", F.lit(None).cast("double").alias("reaction"), F.lit(1).alias("__k"))
    w = Window.partitionBy("entity").orderBy("session_no", "__k").rowsBetween(Window.unboundedPreceding, 0)
    both = src.unionByName(pts)
    seen = F.last(F.when(F.col("__k") == 0, F.struct("session_no", "reaction")), ignorenulls=True).over(w)
    out = both.withColumn("__l", seen).where(F.col("__k") == 1)
    fresh = F.col("session_no") - F.col("__l.session_no") <= expiry
    return out.select("entity", "session_no", F.when(fresh, F.col("__l.reaction")).alias("earn_react_1q"))


def drop_close_repeats(events: DataFrame, day: str = "reaction_date", gap_days: int = 28) -> DataFrame:
    """Keep an event when it is more than ``gap_days`` after the event before it, kept or not."""
    d = events.select("entity", day).where(F.col(day).isNotNull() & F.col("entity").isNotNull()).distinct()
    gap = F.datediff(day, F.lag(day).over(Window.partitionBy("entity").orderBy(day)))
    return d.withColumn("__g", gap).where(F.col("__g").isNull() | (F.col("__g") > gap_days)).drop("__g")


def carry_forward(df: DataFrame, value: str, out: str, limit: int | None = None) -> DataFrame:
    """Last known value on a dense grid, unbounded or for at most ``limit`` rows."""
    first = Window.unboundedPreceding if limit is None else -limit
    return df.withColumn(out, F.last(value, ignorenulls=True).over(by_session().rowsBetween(first, 0)))


def cumulative_growth(df: DataFrame, ret: str = "ret", keys: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Equity curve, its running maximum and the drawdown of a short return series per key.

    A plain product keeps a -100% period at zero, which log sums cannot."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("equity", F.product(1 + F.col(ret)).over(w))
    d = d.withColumn("peak", F.max("equity").over(w))
    return d.withColumn("drawdown", F.try_divide("equity", "peak") - 1)


def long_enough(bars: DataFrame, least: int = 252) -> DataFrame:
    """Entities with at least ``least`` observed closes anywhere."""
    ok = bars.groupBy("entity").agg(F.count("close").alias("__n")).where(F.col("__n") >= least).select("entity")
    return bars.join(ok, "entity", "left_semi")
