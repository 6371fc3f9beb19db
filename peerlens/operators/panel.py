"""Point-in-time panel assembly: rebalance dates x members, everything sampled as known."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from ..sources.text import newest_per_key
from .asof import asof_join, label_members, members_on, sample_exact_then_carry
from .calendar import rebalance_dates, session_calendar, with_sessions
from .fundamentals import valuation
from .labels import delisted_flag, exclusion_log, forward_returns
from .peers import PEER_KEYS, relative_to_median
from .timeseries import (
    carry_forward, dense_grid, drop_close_repeats, event_reactions, flow_ratio, latest_reaction, market_returns, net_purchase_ratio,
    price_features_at, short_flow_features,
)

PRICE_FREE = (
    "roe", "roa", "gross_margin", "fcf_margin", "accruals_ocf_ni", "roe_yoy", "gross_margin_yoy", "asset_growth_yoy",
    "net_issuance_yoy",
)
FUND_LEVELS = ("net_income_ttm", "ebitda_ttm", "revenue_ttm", "fcf_ttm", "total_debt", "cash", "shares", "total_assets")
PRICE_NAMES = ("mom_12_1", "reversal_1m", "high_52w", "max_ret_1m", "beta_252d", "ivol_63d", "amihud_63d")


def build_panel(
    bars: DataFrame, membership: DataFrame, labels: DataFrame | None = None, default_index: str = "CORE",
    bench: DataFrame | None = None, fundamentals: DataFrame | None = None, short_flow: DataFrame | None = None,
    insider_flow: DataFrame | None = None, earnings: DataFrame | None = None, estimates: DataFrame | None = None,
    short_float: DataFrame | None = None, freq: str = "M", month: int = 21, quarter: int = 63, year: int = 252,
    half_year: int = 126, half_year_least: int = 63, expiry: int = 70, history_start: str | None = None,
    horizons: Mapping[str, int] | None = None, model_horizons: Mapping[str, int] | None = None,
    large: bool | None = None, materialise: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(panel, exclusions). A feed that is absent leaves its columns NULL, so the schema is fixed.

    ``bars`` is unique per (entity, date) with close and volume. ``materialise`` writes the bars
    and the labels once to the shared checkpoint folder, because many branches read them.
    ``history_start``: the day from which insider filings are complete; the minimum of sessions counts from it.
    """
    horizons = dict(horizons or {"1m": month, "1q": quarter, "2q": 2 * quarter, "4q": 4 * quarter})
    model_horizons = dict(model_horizons or {"1q": 1, "2q": 2})
    calendar = session_calendar(bars)
    stamped = with_sessions(bars, calendar)
    if materialise:
        # everything below reads the bars: write them once
        stamped = durable(stamped)
        calendar = durable(stamped.select("date", "session_no").distinct())
        bars = stamped.drop("session_no")
    dates = rebalance_dates(calendar, freq)
    mkt = market_returns(bench, calendar) if bench is not None else None

    members = members_on(membership, dates)
    if labels is not None:
        members = label_members(members, labels, default_index)
    else:
        members = members.withColumn("index_name", F.lit(default_index))
    traded = bars.select("entity").distinct()
    panel = members.join(traded, "entity", "left_semi").select("date", "entity", "sector", "index_name")
    panel = with_sessions(panel, calendar)

    # carried samples: last value at or before the date, column by column
    panel = panel.join(price_features_at(stamped, panel.select("entity", "session_no").distinct(), mkt, month, quarter, year), ["entity", "session_no"], "left")
    panel = panel.select("*", *[F.lit(None).cast("double").alias(c) for c in PRICE_NAMES if c not in panel.columns])
    if short_flow is not None:
        # of repeated days the last arrival counts; without an arrival column the higher ratio
        if "arrival" in short_flow.columns:
            short_flow = newest_per_key(short_flow, ["entity", "date"], "arrival")
        ratio = flow_ratio(short_flow).groupBy("entity", "date").agg(F.max("ratio").alias("ratio"))
        shorts = short_flow_features(dense_grid(with_sessions(ratio, calendar), calendar, ["ratio"]))
        for c in ("short_vol_ratio", "short_vol_chg"):
            shorts = carry_forward(shorts, c, c)
        panel = panel.join(shorts.select("entity", "session_no", "short_vol_ratio", "short_vol_chg"), ["entity", "session_no"], "left")
    else:
        panel = panel.select("*", *[F.lit(None).cast("double").alias(c) for c in ("short_vol_ratio", "short_vol_chg")])

    # exact samples: deliberate NULLs survive
    if insider_flow is not None:
        npr = net_purchase_ratio(insider_flow, calendar, half_year, half_year_least, history_start)
        panel = panel.join(sample_exact_then_carry(npr, dates, ["insider_npr_6m"]), ["entity", "date"], "left")
    else:
        panel = panel.withColumn("insider_npr_6m", F.lit(None).cast("double"))
    if earnings is not None and mkt is not None:
        react = latest_reaction(event_reactions(drop_close_repeats(earnings), stamped, calendar, mkt), panel, expiry)
        panel = panel.join(react.distinct(), ["entity", "session_no"], "left")
    else:
        panel = panel.withColumn("earn_react_1q", F.lit(None).cast("double"))

    # statements known by the date, and the price of the day
    if fundamentals is not None:
        cols = [*PRICE_FREE, *FUND_LEVELS]
        panel = asof_join(panel, fundamentals, "date", "as_of", cols, ["quarter_end"])
        px = bars.where(F.col("close").isNotNull()).select("entity", F.col("date").alias("px_date"), "close")
        panel = asof_join(panel, px, "date", "px_date", ["close"])
        panel = valuation(panel).withColumnRenamed("as_of", "fund_as_of").drop(*FUND_LEVELS, "close", "px_date")
    else:
        missing = [*PRICE_FREE, "pe_ratio", "ev_to_ebitda", "ps_ratio", "fcf_yield"]
        panel = panel.select("*", *[F.lit(None).cast("double").alias(c) for c in missing], F.lit(None).cast("date").alias("fund_as_of"))
    if estimates is not None:
        panel = asof_join(panel, estimates, "date", "est_as_of", ["est_revision_3m", "sue"]).drop("est_as_of")
    else:
        panel = panel.select("*", *[F.lit(None).cast("double").alias(c) for c in ("est_revision_3m", "sue")])
    if short_float is not None:
        panel = panel.join(short_float.select("entity", "short_pct_float"), "entity", "left")
    else:
        panel = panel.withColumn("short_pct_float", F.lit(None).cast("double"))

    # labels
    forward = forward_returns(panel.select("entity", "date", "session_no"), stamped, calendar, horizons)
    if materialise:
        forward = durable(forward)
    panel = panel.join(forward.select("entity", "date", *[F.col(f"ret_{n}").alias(f"fwd_ret_{n}") for n in horizons]), ["entity", "date"], "left")
    panel = delisted_flag(panel, [f"fwd_ret_{n}" for n in model_horizons])
    panel = relative_to_median(panel, {f"fwd_ret_{n}": f"fwd_rel_ret_{n}" for n in horizons}, PEER_KEYS, large=large)
    return panel.drop("session_no"), exclusion_log(forward, model_horizons)
