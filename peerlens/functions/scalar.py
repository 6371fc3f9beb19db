"""Scalar column expressions. Missing is always NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def safe_ratio(n: str | Column, d: str | Column) -> Column:
    """n / d, NULL when either side is missing, not finite, or d is zero."""
    return F.try_divide(finite(n), finite(d))


def clean_round(c: str | Column, digits: int = 4) -> Column:
    return F.round(finite(c), digits)


def market_key(c: str | Column) -> Column:
    """Trim, upper-case and write share classes with a dash."""
    return F.regexp_replace(F.upper(F.trim(col(c))), r"\.", "-")


def slash_to_dash(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "/", "-")


def dash_to_slash(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "-", "/")


def clip(c: str | Column, lo: Column, hi: Column) -> Column:
    """Clip that leaves NULL alone (least/greatest would skip it)."""
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def row_count(cols: Sequence[str | Column]) -> Column:
    """How many of the columns are present in this row."""
    total = F.lit(0)
    for c in cols:
        total = total + F.when(col(c).isNotNull(), 1).otherwise(0)
    return total


def row_mean(cols: Sequence[str | Column]) -> Column:
    """Mean over the present columns of a row."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(col(c), F.lit(0.0))
    return F.try_divide(total, row_count(cols).cast("double"))


def bucket_of(rank: Column, n: Column, buckets: int) -> Column:
    """ceil(rank * buckets / n) in whole numbers, held to [1, buckets]."""
    raw = F.floor((rank * F.lit(buckets) + n - F.lit(1)) / n)
    return F.least(F.greatest(raw, F.lit(1)), F.lit(buckets)).cast("int")


def quantile_bin(rank: Column, n: Column, bins: int) -> Column:
    """Equal-width bins of rank on [1, n], right-closed, first bin closed on both ends."""
    raw = F.ceil((rank - F.lit(1)) * F.lit(bins) / (n - F.lit(1)))
    return F.greatest(raw, F.lit(1)).cast("int")


def tier_of(pct: str | Column, edges: Sequence[tuple[float, float, str]], missing: str = "Unknown") -> Column:
    """Half-open tiers [lo, hi); NULL gives ``missing``, anything past the last edge the last name."""
    x = col(pct)
    out = F.when(x.isNull(), F.lit(missing))
    for lo, hi, name in edges:
        out = out.when((x >= lo) & (x < hi), F.lit(name))
    return out.otherwise(F.lit(edges[-1][2]))


def weekdays_between(start: str | Column, end: str | Column) -> Column:
    """Monday-Friday days in [start, end), by closed form; negative spans give the negated count."""

    def index(d: Column) -> Column:
        days = F.datediff(d, F.lit("1970-01-05").cast("date"))  # a Monday
        week = F.floor(days / 7)
        return week * 5 + F.least(days - week * 7, F.lit(5))

    return (index(col(end)) - index(col(start))).cast("int")


def next_weekday(d: str | Column) -> Column:
    """The following Monday-Friday day, as adding one business day does."""
    x = col(d)
    dow = F.dayofweek(x)  # 1 = Sunday
    step = F.when(dow == 6, 3).when(dow == 7, 2).otherwise(1)
    return F.date_add(x, step)


def reaction_day(filed: str | Column, accepted_utc: str | Column, zone: str = "America/New_York") -> Column:
    """First day whose close can reflect a filing: accepted at or after 16:00 local
    moves to the next weekday; an unknown acceptance keeps the filing day."""
    # zone-free timestamps, so the session time zone plays no part
    utc = F.regexp_replace(col(accepted_utc), "Z$", "").try_cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    day = F.to_date(local)
    return F.when(local.isNull(), F.to_date(col(filed))).otherwise(
        F.when(F.hour(local) >= 16, next_weekday(day)).otherwise(day)
    )


def utc_instant(wall: str | Column) -> Column:
    """A zone-free timestamp read as UTC, whatever the session time zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), col(wall)).cast("timestamp")


def utc_day(instant: str | Column) -> Column:
    """The UTC calendar day of an instant, whatever the session time zone."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), col(instant).cast("timestamp_ntz")))
