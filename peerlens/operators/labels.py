"""Forward returns with integrity gates: splices, implausible moves, disappearances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TERMINAL_RETURN = -1.0


def price_anomalies(bars: DataFrame, high: float = 4.0, low: float = 0.25) -> DataFrame:
    """Consecutive present closes whose ratio leaves the sane band."""
    w = Window.partitionBy("entity").orderBy("session_no")
    d = bars.where(F.col("close").isNotNull())
    ratio = F.try_divide("close", F.lag("close").over(w))
    return (
        d.withColumn("ratio", ratio)
        .where((F.col("ratio") > high) | (F.col("ratio") < low))
        .select("entity", "date", "session_no", "ratio", F.lit("daily_jump").alias("reason"))
    )


def last_sessions(bars: DataFrame) -> DataFrame:
    """Last session with a close per entity."""
    return bars.groupBy("entity").agg(
        F.max(F.when(F.col("close").isNotNull(), F.col("date"))).alias("last_valid"),
        F.max(F.when(F.col("close").isNotNull(), F.col("session_no"))).alias("last_session"),
    )


def forward_returns(
    points: DataFrame, bars: DataFrame, calendar: DataFrame, horizons: Mapping[str, int], high: float = 4.0, low: float = 0.25,
    buffer_days: int = 15, max_abs: float = 50.0, terminal: float = TERMINAL_RETURN,
) -> DataFrame:
    """Forward returns of every (entity, date, session_no) point, all horizons in one pass.

    The price now is the last present close at or before the point; the target session must
    have traded. Gates, in order: a splice inside the window, an implausible size, then names
    that stopped trading inside the window get ``terminal``. Excluded cells are never filled.
    Columns per horizon: ``ret_<n>``, ``reason_<n>``, ``excluded_<n>``.

    Points and closes of an entity share one window; both are bounded by the calendar.
    """
    present = bars.where(F.col("close").isNotNull())
    jump = F.try_divide("close", F.lag("close").over(Window.partitionBy("entity").orderBy("session_no")))
    px = present.select(
        "entity", "session_no", "close", F.lit(None).cast("date").alias("date"), F.lit(0).alias("__k"),
        ((jump > high) | (jump < low)).alias("__jump"),
    )
    pts = points.select(
        "entity", "session_no", F.lit(None).cast("double").alias("close"), "date", F.lit(1).alias("__k"), F.lit(None).cast("boolean").alias("__jump")
    )
    both = px.unionByName(pts)
    past = Window.partitionBy("entity").orderBy("session_no", "__k").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("entity").orderBy("session_no")
    seen = both.select(
        "*",
        F.last("close", ignorenulls=True).over(past).alias("p_now"),
        F.max(F.when(F.col("__k") == 0, F.col("session_no"))).over(Window.partitionBy("entity")).alias("last_session"),
        *[F.max("close").over(ahead.rangeBetween(h, h)).alias(f"__fut_{n}") for n, h in horizons.items()],
        *[F.max("__jump").over(ahead.rangeBetween(1, h)).alias(f"__splice_{n}") for n, h in horizons.items()],
    ).where(F.col("__k") == 1)
    # the calendar is one row per session
    d = seen.join(F.broadcast(calendar.select(F.col("session_no").alias("last_session"), F.col("date").alias("last_valid"))), "last_session", "left")
    for n, h in horizons.items():
        target = calendar.select((F.col("session_no") - h).alias("session_no"), F.col("date").alias(f"__tgt_{n}"))
        d = d.join(F.broadcast(target), "session_no", "left")
    d = d.join(F.broadcast(calendar.agg(F.max("date").alias("__end"))), F.lit(True))
    out = []
    for n, h in horizons.items():
        raw = F.try_divide(F.col(f"__fut_{n}"), F.col("p_now")) - 1
        reason = F.when(raw.isNotNull() & F.coalesce(F.col(f"__splice_{n}"), F.lit(False)), "splice_window").when(F.abs(raw) > max_abs, "extreme_return")
        horizon_end = F.coalesce(F.col(f"__tgt_{n}"), F.date_add("date", int(h * 1.5)))
        gone = (
            raw.isNull()
            & F.col("p_now").isNotNull()
            & (F.col("last_valid") < F.date_sub("__end", buffer_days))
            & (F.col("last_valid") > F.col("date"))
            & (F.col("last_valid") < horizon_end)
        )
        out += [
            F.when(reason.isNotNull(), None).when(gone, F.lit(terminal)).otherwise(raw).alias(f"ret_{n}"),
            reason.alias(f"reason_{n}"),
            F.when(reason.isNotNull(), raw).alias(f"excluded_{n}"),
        ]
    return d.select("entity", "date", *out)


def exclusion_log(forward: DataFrame, horizons: Mapping[str, int]) -> DataFrame:
    """One row per label the gates refused, for the horizons given as name -> quarters."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(q).alias("horizon_q"), F.col(f"reason_{n}").alias("reason"), F.col(f"excluded_{n}").alias("value"))
                for n, q in horizons.items()
            ]
        )
    )
    return forward.select("date", "entity", cells.alias("x")).select("date", "entity", "x.*").where(F.col("reason").isNotNull())


def delisted_flag(df: DataFrame, returns: Sequence[str], out: str = "delisted") -> DataFrame:
    """True when any model-horizon return is exactly the terminal value."""
    cond = F.lit(False)
    for r in returns:
        cond = cond | F.coalesce(F.col(r) == TERMINAL_RETURN, F.lit(False))
    return df.withColumn(out, cond)


def gap_returns(df: DataFrame, price: str, steps: Mapping[str, int], period: str = "period_no") -> DataFrame:
    """Return to the price exactly k periods ahead; NULL when the entity is absent there."""
    w = Window.partitionBy("entity").orderBy(period)
    return df.select(
        "*",
        *[
            (F.try_divide(F.max(price).over(w.rangeBetween(k, k)), F.col(price)) - 1).alias(n)
            for n, k in steps.items()
        ],
    )
