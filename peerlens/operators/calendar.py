"""Sessions, rebalance dates and cross sections. Calendars hold one row per day, never per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def session_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """(date, session_no): every session any entity traded, numbered from 0."""
    days = df.select(F.col(date).alias("date")).where(F.col("date").isNotNull()).distinct()
    return days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("session_no"))


def with_sessions(df: DataFrame, calendar: DataFrame, date: str = "date") -> DataFrame:
    """Stamp the session number; the calendar is one row per day, so it is broadcast."""
    return df.join(F.broadcast(calendar.select(F.col("date").alias(date), "session_no")), date)


def next_session(events: DataFrame, calendar: DataFrame, day: str, out: str = "session_no") -> DataFrame:
    """First session at or after a day; days past the last session are dropped."""
    w = Window.orderBy("date")
    spans = calendar.select(
        F.date_add(F.lag("date").over(w), 1).alias("__from"), F.col("date").alias("__to"), F.col("session_no").alias(out)
    )
    days = spans.select(F.explode(F.when(F.col("__from").isNull(), F.array("__to")).otherwise(
        F.sequence("__from", "__to"))).alias("__day"), F.col("__to").alias(f"{out}_date"), out)
    opening = spans.where(F.col("__from").isNull()).select(F.col("__to").alias("__open"), F.col(out).alias("__open_no"))
    # calendar days between sessions are enumerated, so the lookup is an equi join
    j = events.join(F.broadcast(days), F.col(day) == F.col("__day"), "left").join(
        F.broadcast(opening), F.lit(True), "left"
    )
    before = F.col(day) < F.col("__open")
    return j.select(
        *events.columns,
        F.when(before, F.col("__open_no")).otherwise(F.col(out)).alias(out),
        F.when(before, F.col("__open")).otherwise(F.col(f"{out}_date")).alias(f"{out}_date"),
    ).where(F.col(out).isNotNull())


def rebalance_dates(calendar: DataFrame, freq: str = "M") -> DataFrame:
    """Last session of each month (M) or quarter (Q)."""
    unit = {"M": "month", "Q": "quarter"}[freq]
    return calendar.groupBy(F.trunc("date", unit).alias("__p")).agg(F.max("date").alias("date")).select("date")


def quarter_end_subset(df: DataFrame) -> DataFrame:
    """Rows on the last cross section of each calendar quarter."""
    last = df.select("date").distinct().groupBy(F.trunc("date", "quarter").alias("__q")).agg(
        F.max("date").alias("date")
    )
    return df.join(F.broadcast(last.select("date")), "date", "left_semi")


def with_period_number(df: DataFrame, out: str = "period_no") -> DataFrame:
    """Position of each date in the sorted list of dates, from 0."""
    cal = session_calendar(df).withColumnRenamed("session_no", out)
    return df.join(F.broadcast(cal), "date")


def latest_cross_section(df: DataFrame) -> DataFrame:
    last = df.agg(F.max("date").alias("date"))
    return df.join(F.broadcast(last), "date", "left_semi")


def comparison_dates(df: DataFrame, days_back: int = 75) -> DataFrame:
    """One row: latest date and the newest date at least ``days_back`` earlier (else the one before latest)."""
    days = df.select("date").distinct().withColumn("latest", F.max("date").over(Window.partitionBy()))
    target = F.date_sub("latest", days_back)
    return days.groupBy("latest").agg(
        F.coalesce(
            F.max(F.when(F.col("date") <= target, F.col("date"))), F.max(F.when(F.col("date") < F.col("latest"), F.col("date")))
        ).alias("previous")
    )


def previous_cross_section(df: DataFrame, days_back: int = 75) -> DataFrame:
    prev = comparison_dates(df, days_back).select(F.col("previous").alias("date"))
    return df.join(F.broadcast(prev), "date", "left_semi")
