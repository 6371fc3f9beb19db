"""Peer normalisation, scoring, risk and name-level tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar, evaluation, peers, reporting, scoring
from ..operators.ranking import average_rank, group_quantiles, numbered
from . import views as v
from .catalog_feeds import part_overrides
from .reference_sql import WG, decile_sql, fam, ic_sql, mean_sql, neutral_sql, rank_pct_sql, with_views, z_sql, IX
from .registry import big, query, r6, tidy

Z = [f"{f}__n" for f in v.FACTORS]
FAMS = [scoring.family_column(g) for g in v.FAMILIES]
RETS = [f"fwd_rel_ret_{h}" for h in v.HORIZONS]


@query("peer_zscores", with_views(f"SELECT date, entity, {r6(*Z)} FROM neutral", "neutral"))
def peer_zscores(spark, sf):
    return tidy(v.neutral(spark, sf), "date", "entity", *Z)


@query(
    "peer_rank_variant",
    with_views(
        "SELECT date, entity, "
        + ", ".join(f"round(({rank_pct_sql('w_' + f, WG)} - 0.5)*{s},6) AS {f}__n" for f, s in v.FACTORS.items())
        + " FROM w",
        "panel",
        extra={
            "b": f"SELECT *, count(*) OVER ({WG}) AS rows_, "
            + ", ".join(f"quantile_cont({f},0.02) OVER ({WG}) AS lo_{f}, quantile_cont({f},0.98) OVER ({WG}) AS hi_{f}" for f in v.FACTORS)
            + " FROM panel",
            "w": "SELECT date, entity, sector, index_name, "
            + ", ".join(f"round(least(greatest({f},lo_{f}),hi_{f}),9) AS w_{f}" for f in v.FACTORS)
            + " FROM b WHERE rows_>=5",
        },
    ),
)
def peer_rank_variant(spark, sf):
    d = peers.neutralize(v.panel(spark, sf), v.FACTORS, method="rank", large=v.large_peers(spark, sf))
    return tidy(d, "date", "entity", *[f"{f}__n" for f in v.FACTORS])


@query(
    "small_peer_groups_dropped",
    with_views(f"SELECT date, sector, index_name, count(*) AS n FROM (SELECT *, count(*) OVER ({WG}) AS c FROM panel) WHERE c>=10 GROUP BY 1,2,3", "panel"),
)
def small_peer_groups_dropped(spark, sf):
    d = peers.drop_small_groups(v.panel(spark, sf), min_rows=10, large=v.large_peers(spark, sf))
    return d.groupBy("date", "sector", "index_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "winsorized_factors",
    with_views(
        "SELECT date, entity, "
        + ", ".join(f"round(least(greatest({f},quantile_cont({f},0.02) OVER ({WG})),quantile_cont({f},0.98) OVER ({WG})),10) AS {f}_w" for f in v.FACTORS)
        + f" FROM (SELECT * FROM (SELECT *, count(*) OVER ({WG}) AS c FROM panel) WHERE c>=3)",
        "panel",
    ),
)
def winsorized_factors(spark, sf):
    d = peers.drop_small_groups(v.panel(spark, sf), min_rows=3, large=v.large_peers(spark, sf))
    w = peers.winsorize(d, list(v.FACTORS), peers.PEER_KEYS, 0.02, large=v.large_peers(spark, sf))
    return tidy(w, "date", "entity", *[f"{f}_w" for f in v.FACTORS], digits=10)


@query(
    "winsorized_labels_by_date",
    with_views(
        "SELECT date, entity, round(CASE WHEN c>=10 THEN least(greatest(y,lo),hi) ELSE y END,6) AS y_w FROM (SELECT date, entity, fwd_rel_ret_1q AS y, count(*) OVER (PARTITION BY date) AS c, "
        "quantile_cont(fwd_rel_ret_1q,0.01) OVER (PARTITION BY date) AS lo, quantile_cont(fwd_rel_ret_1q,0.99) OVER (PARTITION BY date) AS hi FROM panel WHERE fwd_rel_ret_1q IS NOT NULL)",
        "panel",
    ),
)
def winsorized_labels_by_date(spark, sf):
    d = v.panel(spark, sf).where(F.col("fwd_rel_ret_1q").isNotNull()).select("date", "entity", F.col("fwd_rel_ret_1q").alias("y"))
    return tidy(evaluation.clip_labels(d, "y", "y_w", ["date"], large=v.large(spark, sf)), "date", "entity", "y_w")


@query("peer_relative_labels", with_views(f"SELECT date, entity, {r6(*RETS)} FROM panel", "panel"))
def peer_relative_labels(spark, sf):
    return tidy(v.panel(spark, sf), "date", "entity", *RETS)


@query(
    "family_balanced_score",
    with_views(f"SELECT date, entity, {r6(*FAMS, 'score_ew')}, {big('n_factors_used', 'n_families_used')} FROM scored", "scored"),
)
def family_balanced_score(spark, sf):
    return tidy(v.scored(spark, sf), "date", "entity", *FAMS, "score_ew", "n_factors_used", "n_families_used")


@query("peer_deciles", with_views(f"SELECT date, entity, {big('decile_ew')} FROM scored", "scored"))
def peer_deciles(spark, sf):
    return tidy(v.scored(spark, sf), "date", "entity", "decile_ew")


@query(
    "decile_sizes",
    with_views("SELECT date, sector, index_name, CAST(decile_ew AS BIGINT) AS decile_ew, count(*) AS n FROM scored GROUP BY 1,2,3,4", "scored"),
)
def decile_sizes(spark, sf):
    g = v.scored(spark, sf).groupBy("date", "sector", "index_name", "decile_ew").agg(F.count(F.lit(1)).alias("n"))
    return tidy(g)


def _newest(spark, sf, view=v.scored, *more):
    """Latest cross section; the narrow panel is held because its newest date is looked up first."""
    return calendar.latest_cross_section(v.kept(view(spark, sf), "date", "entity", "sector", "score_ew", "decile_ew", *more))


@query(
    "worst_ten_names",
    with_views(
        f"SELECT date, entity, sector, {r6('score_ew')}, {big('decile_ew')}, row_number() OVER (ORDER BY round(score_ew,9) DESC, entity) AS sell_rank FROM scored "
        "WHERE date=(SELECT max(date) FROM scored) AND score_ew IS NOT NULL ORDER BY round(score_ew,9) DESC, entity LIMIT 10",
        "scored",
    ),
)
def worst_ten_names(spark, sf):
    latest = _newest(spark, sf)
    top = reporting.top_names(latest, "score_ew", 10)
    return tidy(reporting.worst_first(top, "score_ew", large=False), "date", "entity", "sector", "score_ew", "decile_ew", "sell_rank")


@query(
    "sell_ranks",
    with_views(
        "SELECT entity, row_number() OVER (ORDER BY round(score_ew,9) DESC, entity) AS sell_rank FROM scored WHERE date=(SELECT max(date) FROM scored) AND score_ew IS NOT NULL",
        "scored",
    ),
)
def sell_ranks(spark, sf):
    latest = _newest(spark, sf).where(F.col("score_ew").isNotNull())
    return tidy(reporting.worst_first(latest, "score_ew", large=v.large(spark, sf)), "entity", "sell_rank")


@query(
    "calibration_bin_assignment",
    with_views(
        "SELECT date, entity, CAST(greatest(1, ceil((k-1)*10.0/(m-1))) AS BIGINT) AS score_q FROM (SELECT date, entity, "
        "row_number() OVER (PARTITION BY date ORDER BY round(score_ew,9), entity) AS k, count(*) OVER (PARTITION BY date) AS m FROM scored WHERE score_ew IS NOT NULL) WHERE m>=20",
        "scored",
    ),
)
def calibration_bin_assignment(spark, sf):
    d = v.scored(spark, sf).where(F.col("score_ew").isNotNull()).select("date", "entity", "score_ew")
    return tidy(peers.calibration_bins(d, "score_ew", large=v.large(spark, sf)), "date", "entity", "score_q")


IXN = [f"{n}__n" for n in v.INTERACTIONS]


@query("family_interactions", with_views(f"SELECT date, entity, {', '.join(f'round({n},6) AS {n}' for n in IXN)} FROM x", "scored", extra={"x": f"SELECT *, {IX} FROM scored"}))
def family_interactions(spark, sf):
    d = v.crossed(spark, sf)
    return tidy(d, "date", "entity", *IXN)


@query("absolute_risk", with_views(f"SELECT date, entity, {r6('risk_score', 'risk_pct')}, risk_tier, {big('n_risk_used')} FROM risked", "risked"))
def absolute_risk(spark, sf):
    return tidy(v.risked(spark, sf), "date", "entity", "risk_score", "risk_pct", "risk_tier", "n_risk_used")


@query(
    "latest_risk_table",
    with_views(
        f"SELECT entity, {r6('risk_pct')}, risk_tier, row_number() OVER (ORDER BY round(risk_pct,9) DESC, entity) AS risk_rank FROM risked WHERE date=(SELECT max(date) FROM risked) AND risk_pct IS NOT NULL",
        "risked",
    ),
)
def latest_risk_table(spark, sf):
    return tidy(reporting.latest_risk(v.kept(v.risked(spark, sf), "date", "entity", "risk_pct", "risk_tier"), large=v.large(spark, sf)), "entity", "risk_pct", "risk_tier", "risk_rank")


@query(
    "risk_tier_counts",
    with_views("SELECT risk_tier, count(*) AS n FROM risked WHERE date=(SELECT max(date) FROM risked) AND risk_pct IS NOT NULL GROUP BY 1", "risked"),
)
def risk_tier_counts(spark, sf):
    return reporting.tier_counts(_newest(spark, sf, v.risked, "risk_pct", "risk_tier"))


@query(
    "average_rank_of_ties",
    with_views(
        "SELECT date, entity, rank() OVER (PARTITION BY date ORDER BY f_lines) + (count(*) OVER (PARTITION BY date, f_lines)-1)/2.0 AS avg_rank, "
        "round((rank() OVER (PARTITION BY date ORDER BY f_lines) + (count(*) OVER (PARTITION BY date, f_lines)-1)/2.0)/count(*) OVER (PARTITION BY date),6) AS pct_rank FROM panel",
        "panel",
    ),
)
def average_rank_of_ties(spark, sf):
    d = average_rank(v.panel(spark, sf).select("date", "entity", "f_lines"), ["date"], "f_lines", "avg_rank", ["entity"], v.large(spark, sf))
    return tidy(d.withColumn("pct_rank", F.col("avg_rank") / F.col("avg_rank_n")), "date", "entity", "avg_rank", "pct_rank")


@query(
    "first_come_rank",
    with_views("SELECT date, entity, row_number() OVER (PARTITION BY date ORDER BY f_lines, entity) AS row_no, count(*) OVER (PARTITION BY date) AS group_n FROM panel", "panel"),
)
def first_come_rank(spark, sf):
    return numbered(v.panel(spark, sf).select("date", "entity", "f_lines"), ["date"], ["f_lines", "entity"], large=v.large(spark, sf)).drop("f_lines")


@query(
    "exact_group_quantiles",
    with_views(
        "SELECT date, round(quantile_cont(f_px,0.02),6) AS lo, round(quantile_cont(f_px,0.5),6) AS mid, round(quantile_cont(f_px,0.98),6) AS hi, count(f_px) AS n FROM panel GROUP BY 1", "panel"
    ),
)
def exact_group_quantiles(spark, sf):
    q = group_quantiles(v.panel(spark, sf), ["date"], ["f_px"], [0.02, 0.5, 0.98], v.large(spark, sf))
    return tidy(q.select("date", *[F.col("f_px_q")[i].alias(n) for i, n in enumerate(("lo", "mid", "hi"))], F.col("f_px_c").alias("n")))


# --- names -----------------------------------------------------------------------------

_PREV = (
    "pd AS (SELECT coalesce(max(CASE WHEN date <= top - 75 THEN date END), max(CASE WHEN date < top THEN date END)) AS date "
    "FROM (SELECT DISTINCT date FROM risked) CROSS JOIN (SELECT max(date) AS top FROM risked))"
)
_LATEST = {
    "pd": _PREV[len("pd AS (") : -1],
    "cur": "SELECT * FROM risked WHERE date=(SELECT max(date) FROM risked)",
    "prv": "SELECT * FROM risked WHERE date=(SELECT date FROM pd)",
    "lat": "SELECT cur.*, prv.score_ew AS prev_score_ew, prv.decile_ew AS prev_decile_ew, prv.date AS prev_date FROM cur LEFT JOIN prv ON cur.entity=prv.entity",
}


@query("comparison_dates", with_views("SELECT (SELECT max(date) FROM risked) AS latest, date AS previous FROM pd", "risked", extra={"pd": _LATEST["pd"]}))
def comparison_dates(spark, sf):
    return calendar.comparison_dates(v.scored(spark, sf))


@query(
    "scores_with_previous",
    with_views(f"SELECT entity, {r6('score_ew', 'prev_score_ew')}, {big('decile_ew', 'prev_decile_ew')}, prev_date FROM lat", "risked", extra=_LATEST),
)
def scores_with_previous(spark, sf):
    d = reporting.with_previous(v.kept(v.scored(spark, sf), "date", "entity", "score_ew", "decile_ew"), ["score_ew", "decile_ew"])
    return tidy(d, "entity", "score_ew", "prev_score_ew", "decile_ew", "prev_decile_ew", "prev_date")


_LONG = " UNION ALL ".join(
    f"SELECT cur.entity, cur.sector, '{f}' AS factor, cur.{f} AS raw, cur.{f}__n AS z, prv.{f}__n AS prev_z FROM cur LEFT JOIN prv ON cur.entity=prv.entity" for f in v.FACTORS
)
_DEC = {**{k: _LATEST[k] for k in ("pd", "cur", "prv")}, "lng": _LONG}


def _factor_rows(spark, sf):
    return v.kept(v.scored(spark, sf), "date", "entity", "sector", *v.FACTORS, *Z)


@query(
    "factor_decomposition",
    with_views(
        f"SELECT entity, factor, raw, {r6('z', 'prev_z')}, round({rank_pct_sql('z', 'PARTITION BY sector, factor', '100.0')},6) AS pct FROM lng", "risked", extra=_DEC
    ),
)
def factor_decomposition(spark, sf):
    d = reporting.decomposition(_factor_rows(spark, sf), list(v.FACTORS), large=v.large(spark, sf))
    return tidy(d, "entity", "factor", "raw", "z", "prev_z", "pct", exact=("raw",))


@query(
    "top_flags_per_name",
    with_views(
        f"SELECT entity, factor, {r6('z')}, k AS flag_no FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(z,9) DESC, factor) AS k FROM lng WHERE z>0.5) WHERE k<=2",
        "risked", extra=_DEC,
    ),
)
def top_flags_per_name(spark, sf):
    long = reporting.decomposition(_factor_rows(spark, sf), list(v.FACTORS), large=v.large(spark, sf))
    return tidy(reporting.top_flags(long, 2, 0.5), "entity", "factor", "z", "flag_no")


@query(
    "risk_drivers",
    with_views(
        f"""SELECT entity, factor, {r6('z')}, 'red' AS side, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(z,9) DESC, factor) AS k FROM lng) WHERE z>=0.5 AND k<=3
 UNION ALL SELECT entity, factor, round(z,6), 'green', k FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(z,9), factor) AS k FROM lng) WHERE z<=-0.5 AND k<=2""",
        "risked", extra=_DEC,
    ),
)
def risk_drivers(spark, sf):
    long = reporting.decomposition(_factor_rows(spark, sf), list(v.FACTORS), large=v.large(spark, sf))
    return tidy(reporting.risk_drivers(long))


def _latest_named(spark, sf):
    base = v.kept(v.risked(spark, sf), "date", "entity", "sector", "index_name", "score_ew", "decile_ew", "risk_pct", "risk_tier")
    d = reporting.with_previous(base, ["decile_ew"])
    return d.withColumnRenamed("score_ew", "score").withColumnRenamed("decile_ew", "decile").withColumnRenamed("prev_decile_ew", "prev_decile")


def _holdings(spark, sf):
    """Every part is a holding; some are outside the latest cross section."""
    return v.table(spark, sf, "part").select(F.col("p_partkey").alias("entity"))


_HOLD = {
    **_LATEST,
    "hold": "SELECT p_partkey AS entity FROM part",
    "ov": "SELECT l_partkey AS entity, count(*) AS n FROM lineitem WHERE l_returnflag='R' AND CAST(l_shipdate AS DATE) <= (SELECT max(date) FROM risked) AND CAST(l_shipdate AS DATE)+100 >= (SELECT max(date) FROM risked) GROUP BY 1",
    "rev": """SELECT h.entity, l.entity IS NOT NULL AS in_universe, sector, score_ew AS score, decile_ew AS decile, decile_ew-prev_decile_ew AS change,
 l.entity IS NOT NULL AND coalesce(decile_ew,0)>=9 AND (prev_decile_ew IS NULL OR prev_decile_ew<9) AS is_new,
 coalesce(decile_ew,0)>=9 AND coalesce(risk_tier='Elevated',false) AS is_double, coalesce(decile_ew,0)=10 AS is_review, coalesce(ov.n,0) AS n_overrides
 FROM hold h LEFT JOIN lat l ON h.entity=l.entity LEFT JOIN ov ON ov.entity=h.entity""",
}


@query(
    "holdings_review",
    with_views(f"SELECT entity, in_universe, sector, {r6('score')}, {big('decile', 'change', 'n_overrides')}, is_new, is_double, is_review FROM rev", "risked", extra=_HOLD),
)
def holdings_review(spark, sf):
    latest = v.kept(_latest_named(spark, sf))
    at = latest.agg(F.max("date").alias("__at"))
    ov = part_overrides(spark, sf).join(F.broadcast(at), (F.col("date") <= F.col("__at")) & (F.col("expires") >= F.col("__at")))
    return tidy(reporting.holdings_review(latest, _holdings(spark, sf), ov))


@query(
    "holdings_overlay_summary",
    with_views(
        """SELECT count(*) AS matched, count(*) FILTER (is_review) AS in_worst, count(*) FILTER (is_new) AS newly_flagged, count(*) FILTER (is_double) AS double_flagged,
 round(coalesce(avg(coalesce(decile,0)),0.0),6) AS mean_decile FROM rev WHERE in_universe""",
        "risked", extra=_HOLD,
    ),
)
def holdings_overlay_summary(spark, sf):
    return tidy(reporting.overlay_summary(reporting.holdings_review(_latest_named(spark, sf), _holdings(spark, sf))))


@query(
    "holdings_outside_universe",
    with_views("SELECT entity FROM hold WHERE entity NOT IN (SELECT entity FROM cur)", "risked", extra={"cur": _LATEST["cur"], "hold": _HOLD["hold"]}),
)
def holdings_outside_universe(spark, sf):
    latest = calendar.latest_cross_section(v.scored(spark, sf)).select("entity")
    return _holdings(spark, sf).join(latest, "entity", "left_anti")


@query(
    "score_risk_contrast",
    with_views(
        f"SELECT entity, {r6('score_ew', 'risk_pct')}, decile_ew>=9 AND risk_pct>=70 AS double_trouble FROM cur WHERE score_ew IS NOT NULL AND risk_pct IS NOT NULL AND index_name='SMALL'",
        "risked", extra={"cur": _LATEST["cur"]},
    ),
)
def score_risk_contrast(spark, sf):
    d = reporting.contrast(_latest_named(spark, sf), "SMALL").withColumnRenamed("score", "score_ew")
    return tidy(d, "entity", "score_ew", "risk_pct", "double_trouble")


@query(
    "sector_decile_counts",
    with_views("SELECT sector, CAST(decile_ew AS BIGINT) AS decile, count(*) AS n FROM scored WHERE date=(SELECT max(date) FROM scored) AND decile_ew IS NOT NULL GROUP BY 1,2", "scored"),
)
def sector_decile_counts(spark, sf):
    return tidy(reporting.sector_deciles(_newest(spark, sf), "decile_ew"))


@query(
    "worst_names_by_sector",
    with_views(
        "SELECT sector, entity, row_number() OVER (PARTITION BY sector ORDER BY entity) AS place, count(*) OVER (PARTITION BY sector) AS n_names FROM scored WHERE date=(SELECT max(date) FROM scored) AND decile_ew=10",
        "scored",
    ),
)
def worst_names_by_sector(spark, sf):
    return tidy(reporting.worst_names(_newest(spark, sf), "decile_ew"))


@query(
    "last_event_of_names",
    with_views(
        "SELECT p.entity, p.date, e.last_print FROM (SELECT entity, date FROM panel WHERE date = (SELECT max(date) FROM panel)) p LEFT JOIN ("
        "SELECT l_partkey AS entity, max(CAST(l_shipdate AS DATE)) AS last_print FROM lineitem WHERE CAST(l_shipdate AS DATE) <= (SELECT max(date) FROM panel) GROUP BY 1) e ON e.entity = p.entity",
        "panel",
    ),
)
def last_event_of_names(spark, sf):
    """Newest event day known on the latest date, next to each name of that cross section."""
    points = reporting.latest_cross_section(v.panel(spark, sf, move=False)).select("entity", "date")
    events = v.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.to_date("l_shipdate").alias("day"))
    return reporting.last_event(points, events, "day")
