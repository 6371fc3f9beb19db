"""Grading scores, sleeves and estimation on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar, evaluation as ev, learning, portfolio, reporting, resampling, scoring
from ..session import cheap, durable
from . import views as v
from .reference_sql import IX, WG, decile_sql, fam, hac_cte, hac_sql, ic_sql, mean_sql, with_views, z_sql
from .registry import SQL, big, query, r6, tidy

SCORES = {"score_ew": "score_ew", **{f: f"{f}__n" for f in v.FACTORS}}
FAM = {g: scoring.family_column(g) for g in v.FAMILIES}
LABELS = {h: f"fwd_rel_ret_{h}" for h in v.HORIZONS}
LAGS_Q = {h: ev.overlap_lags(m, "Q") for h, m in v.MONTHS.items()}
LAG_SQL = "CASE horizon " + " ".join(f"WHEN '{h}' THEN {n}" for h, n in LAGS_Q.items()) + " END"
SEL = f"WHERE index_name='{v.SELECTION}'"
STRESS = (
    ("spring 1996", "1996-03-01", "1996-09-30"),
    ("winter 1997", "1997-10-01", "1998-03-31"),
    ("long slump", "1999-01-01", "2000-06-30"),
    ("after the data", "2010-01-01", "2010-12-31"),
)


def selected(d):
    return cheap(d.where(F.col("index_name") == v.SELECTION), d)


def graded(spark, sf, *cols):
    """The selected rows a table is built from, held because clipping bounds and medians read them again."""
    return v.kept(selected(v.scored(spark, sf)), "date", "entity", "score_ew", "decile_ew", "fwd_rel_ret_1q", *cols)


def ics(spark, sf, scores=None, labels=None, sel=True):
    d = v.scored(spark, sf)
    bound = v.large_selected(spark, sf) if sel else v.large(spark, sf)
    return ev.ic_series(selected(d) if sel else d, scores or {"score_ew": "score_ew"}, labels or {"1q": "fwd_rel_ret_1q"}, large=bound)


# --- the learned score in SQL ------------------------------------------------------------

ML = [*v.FEATURES, *[f"{n}__n" for n in v.INTERACTIONS]]
_P = range(len(ML))


def _solve_sql(source: str) -> dict[str, str]:
    """The normal equations of every row of ``source`` (moments n, sy, sx_i, sxy_i, sxx_i_j) solved by elimination, one
    step to a view: ``s0`` has the penalised matrix, ``s<k>`` the rows below pivot k reduced, ``co`` intercept b and slopes w_i."""
    upper = [(i, j) for i in _P for j in range(i, len(ML))]
    start = ", ".join(f"sxx_{i}_{j}-sx_{i}*sx_{j}/n" + ("+10.0" if i == j else "") + f" AS a_{i}_{j}" for i, j in upper)
    rhs = ", ".join(f"sxy_{i}-sx_{i}*sy/n AS r_{i}" for i in _P)
    out = {"s0": f"SELECT *, {start}, {rhs} FROM {source}"}
    for k in _P[:-1]:
        less = [f"a_{i}_{j}-a_{k}_{i}*a_{k}_{j}/a_{k}_{k} AS a_{i}_{j}" for i, j in upper if i > k]
        less += [f"r_{i}-a_{k}_{i}*r_{k}/a_{k}_{k} AS r_{i}" for i in _P if i > k]
        out[f"s{k + 1}"] = f"SELECT * REPLACE ({', '.join(less)}) FROM s{k}"
    last = f"s{len(ML) - 1}"
    for k in reversed(_P):
        known = "".join(f"-a_{k}_{j}*w_{j}" for j in range(k + 1, len(ML)))
        out[f"w{k}"] = f"SELECT *, (r_{k}{known})/a_{k}_{k} AS w_{k} FROM {last}"
        last = f"w{k}"
    out["co"] = "SELECT *, sy/n" + "".join(f"-w_{i}*sx_{i}/n" for i in _P) + f" AS b FROM {last}"
    return out


def _ridge_sql(prior: str, source: str = "scored") -> dict[str, str]:
    """Views from ``x`` (rows with all features) to ``co``; ``prior`` is the training set of each date."""
    sums = ["count(y) AS n", "coalesce(sum(y),0) AS sy"]
    sums += [f"coalesce(sum(x_{i}),0) AS sx_{i}, coalesce(sum(x_{i}*y),0) AS sxy_{i}" for i in _P]
    sums += [f"coalesce(sum(x_{i}*x_{j}),0) AS sxx_{i}_{j}" for i in _P for j in range(i, len(ML))]
    use = "index_name='SMALL' AND fwd_rel_ret_1q IS NOT NULL"
    rows = ", ".join(f"CASE WHEN {use} THEN coalesce({f},0) END AS x_{i}" for i, f in enumerate(ML))
    return {
        "x": f"SELECT *, {IX} FROM {source}",
        "m": f"SELECT date, {', '.join(sums)} FROM (SELECT date, CASE WHEN {use} THEN fwd_rel_ret_1q END AS y, {rows} FROM x) GROUP BY 1",
        "tr": prior,
        **_solve_sql("tr"),
    }


_SUMS = ["n", "sy", *[f"{c}_{i}" for i in _P for c in ("sx", "sxy")], *[f"sxx_{i}_{j}" for i in _P for j in range(i, len(ML))]]
_PRIOR = (
    "SELECT * FROM (SELECT date, row_number() OVER (ORDER BY date)-1 AS prior, " + ", ".join(f"sum({c}) OVER p AS {c}" for c in _SUMS)
    + " FROM m WINDOW p AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE prior>=6 AND n>=50"
)
_WALK, _WALK_M = _ridge_sql(_PRIOR), _ridge_sql(_PRIOR, "scored_m")
_WHOLE = _ridge_sql("SELECT * FROM (SELECT " + ", ".join(f"sum({c}) AS {c}" for c in _SUMS) + " FROM m) WHERE n>=100")
_FITTED = "-(b" + "".join(f"+w_{i}*coalesce({f},0)" for i, f in enumerate(ML)) + ")"
_ML_M = {**_WALK_M, "ml": f"SELECT x.*, {_FITTED} AS score_ml FROM x LEFT JOIN co ON co.date=x.date"}


EW = {"score_ew": "score_ew"}
Q1 = {"1q": "fwd_rel_ret_1q"}
IC1 = {"ics": ic_sql("scored", EW, Q1, SEL)}


@query("rank_ic_by_date", with_views("SELECT date, round(ic,6) AS ic, n FROM ics", "scored", extra=IC1))
def rank_ic_by_date(spark, sf):
    return tidy(ics(spark, sf), "date", "ic", "n")


@query(
    "ic_summary_overlap_corrected",
    with_views(
        f"SELECT series, horizon, round(mean,6) AS mean_ic, {r6('t_stat', 'se', 'ir', 'hit_rate')}, n_periods FROM ({hac_sql('ics', 'series, horizon', 'ic', LAG_SQL)})",
        "scored", extra={"ics": ic_sql("scored", EW, LABELS, SEL), "h": hac_cte("ics", "series, horizon", "ic", LAG_SQL)},
    ),
)
def ic_summary_overlap_corrected(spark, sf):
    s = ev.ic_summary(selected(v.scored(spark, sf)), EW, LABELS, v.MONTHS, "Q", large=v.large(spark, sf))
    return tidy(s, "series", "horizon", "mean_ic", "t_stat", "se", "ir", "hit_rate", "n_periods")


LAGS_M = {h: ev.overlap_lags(m, "M") for h, m in {"1m": 1, **v.MONTHS}.items()}
LAG_SQL_M = "CASE horizon " + " ".join(f"WHEN '{h}' THEN {n}" for h, n in LAGS_M.items()) + " END"
LABELS_M = {"1m": "fwd_rel_ret_1m", **LABELS}


@query(
    "monthly_ic_long_overlap",
    with_views(
        f"SELECT series, horizon, round(mean,6) AS mean_ic, {r6('t_stat', 'ir', 'hit_rate')}, n_periods FROM ({hac_sql('ics', 'series, horizon', 'ic', LAG_SQL_M)})",
        "scored_m", extra={"ics": ic_sql("scored_m", EW, LABELS_M), "h": hac_cte("ics", "series, horizon", "ic", LAG_SQL_M)},
    ),
)
def monthly_ic_long_overlap(spark, sf):
    s = ev.ic_summary(v.scored(spark, sf, "month"), EW, LABELS_M, {"1m": 1, **v.MONTHS}, "M", large=v.large(spark, sf))
    return tidy(s, "series", "horizon", "mean_ic", "t_stat", "ir", "hit_rate", "n_periods")


SERIES = {"score_ew": "score_ew", "score_ml": "score_ml", **{f: f"{f}__n" for f in v.FACTORS}, **FAM}
KIND = {**dict.fromkeys(FAM, "family"), **dict.fromkeys(v.FACTORS, "factor"), "score_ew": "composite", "score_ml": "composite"}
_KIND_CASE = "CASE series " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in KIND.items()) + " END"


def learned(spark, sf, *cols):
    """The selected rows of the monthly panel with their walk-forward score; the other rows are there for the dates before a fit.

    ``cols`` and what the fit reads are written: a table is smaller than held rows, whose doubles are not compressed."""
    d = durable(v.crossed(spark, sf, "month", only=v.SELECTION).select("date", "index_name", *cols, "fwd_rel_ret_1q", *ML))
    return selected(cheap(learning.walk_forward(d, ML, "fwd_rel_ret_1q", F.col("index_name") == v.SELECTION)[0]))


@query(
    "horizon_term_structure",
    with_views(
        f"SELECT series, {_KIND_CASE} AS kind, horizon, round(mean,6) AS mean_ic, {r6('t_stat', 'se', 'ir')}, n_periods FROM ({hac_sql('ics', 'series, horizon', 'ic', LAG_SQL_M)})",
        "scored_m", extra={**_ML_M, "ics": ic_sql("ml", SERIES, LABELS_M, SEL), "h": hac_cte("ics", "series, horizon", "ic", LAG_SQL_M)},
    ),
)
def horizon_term_structure(spark, sf):
    d = learned(spark, sf, "entity", "score_ew", *FAM.values(), *[c for c in LABELS_M.values() if c != "fwd_rel_ret_1q"])
    s = ev.ic_summary(d, SERIES, LABELS_M, {"1m": 1, **v.MONTHS}, "M", large=v.large_selected(spark, sf, ev.ranks_held(len(SERIES) + len(LABELS_M))))
    kinds = F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv])
    return tidy(s.withColumn("kind", kinds[F.col("series")]), "series", "kind", "horizon", "mean_ic", "t_stat", "se", "ir", "n_periods")


FACT = {f: f"{f}__n" for f in v.FACTORS}
_FAMILY_CASE = "CASE series " + " ".join(f"WHEN '{f}' THEN '{g}'" for f, g in v.FAMILY_OF.items()) + " END"


@query(
    "factor_ic_table",
    with_views(
        f"SELECT series AS factor, {_FAMILY_CASE} AS family, round(mean,6) AS mean_ic, {r6('t_stat', 'ir', 'hit_rate')}, n_periods FROM ({hac_sql('ics', 'series, horizon', 'ic', LAG_SQL)})",
        "scored", extra={"ics": ic_sql("scored", FACT, {"4q": "fwd_rel_ret_4q"}, SEL), "h": hac_cte("ics", "series, horizon", "ic", LAG_SQL)},
    ),
)
def factor_ic_table(spark, sf):
    s = ev.ic_summary(selected(v.scored(spark, sf)), FACT, {"4q": "fwd_rel_ret_4q"}, v.MONTHS, "Q", large=v.large(spark, sf))
    return tidy(ev.factor_ic_table(s, v.FAMILY_OF), "factor", "family", "mean_ic", "t_stat", "ir", "hit_rate", "n_periods")


# --- decile tables ---------------------------------------------------------------------

_Y = "SELECT date, entity, CAST(decile_ew AS BIGINT) AS decile, fwd_rel_ret_1q AS y FROM scored WHERE index_name='SMALL' AND decile_ew IS NOT NULL AND fwd_rel_ret_1q IS NOT NULL"


@query(
    "decile_return_table",
    with_views(
        "SELECT decile, round(avg(y),6) AS mean_rel_ret, round(median(y),6) AS median_rel_ret, round(avg(least(greatest(y,lo),hi)),6) AS mean_rel_ret_w, count(*) AS n FROM y "
        "CROSS JOIN (SELECT quantile_cont(y,0.01) AS lo, quantile_cont(y,0.99) AS hi FROM y) GROUP BY 1",
        "scored", extra={"y": _Y},
    ),
)
def decile_return_table(spark, sf):
    d = ev.decile_table(graded(spark, sf), "decile_ew", "fwd_rel_ret_1q", large=v.large(spark, sf, "lineitem"))
    return tidy(d, "decile", "mean_rel_ret", "median_rel_ret", "mean_rel_ret_w", "n")


_SPREAD = "SELECT * FROM (SELECT date, avg(CASE WHEN decile=1 THEN y END)-avg(CASE WHEN decile=10 THEN y END) AS spread, 1 AS one FROM y GROUP BY 1) WHERE spread IS NOT NULL"


@query("decile_spread_by_date", with_views("SELECT date, round(spread,6) AS spread FROM sp", "scored", extra={"y": _Y, "sp": _SPREAD}))
def decile_spread_by_date(spark, sf):
    return tidy(ev.decile_spread(selected(v.scored(spark, sf)), "decile_ew", "fwd_rel_ret_1q"))


@query(
    "decile_spread_summary",
    with_views(
        f"SELECT {r6('mean', 't_stat')}, n_periods FROM ({hac_sql('sp', 'one', 'spread', '1')})", "scored",
        extra={"y": _Y, "sp": _SPREAD, "h": hac_cte("sp", "one", "spread", "1")},
    ),
)
def decile_spread_summary(spark, sf):
    s = ev.decile_spread(selected(v.scored(spark, sf)), "decile_ew", "fwd_rel_ret_1q").withColumn("one", F.lit(1))
    return tidy(ev.hac_mean(s, ["one"], "spread", 1), "mean", "t_stat", "n_periods")


@query(
    "decile_monotonicity",
    with_views(
        "SELECT round(corr(decile, rk),6) AS rho, count(*) AS n FROM (SELECT decile, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m)-1)/2.0 AS rk FROM (SELECT decile, round(avg(y),9) AS m FROM y GROUP BY 1))",
        "scored", extra={"y": _Y},
    ),
)
def decile_monotonicity(spark, sf):
    t = ev.decile_table(graded(spark, sf), "decile_ew", "fwd_rel_ret_1q", large=v.large(spark, sf, "lineitem"))
    return tidy(ev.monotonicity(t), "rho", "n")


@query(
    "score_calibration_table",
    with_views(
        """SELECT score_q, round(avg(m),6) AS mean_rel_ret, round(stddev_samp(m)/sqrt(count(*)),6) AS se, round(avg(md),6) AS median_rel_ret, round(avg(mw),6) AS mean_rel_ret_w,
 round(avg(p),6) AS p_underperform, round(stddev_samp(p)/sqrt(count(*)),6) AS p_underperform_se, round(avg(sc),6) AS mean_score, count(*) AS n_dates, CAST(sum(c) AS BIGINT) AS n_obs,
 round(avg(m)/(stddev_samp(m)/sqrt(count(*))),6) AS t_stat FROM (
 SELECT date, CAST(greatest(1, ceil((k-1)*10.0/(mm-1))) AS BIGINT) AS score_q, avg(y) AS m, median(y) AS md, avg(CASE WHEN mm>=10 THEN least(greatest(y,lo),hi) ELSE y END) AS mw,
  avg(CASE WHEN y<0 THEN 1.0 ELSE 0.0 END) AS p, avg(score_ew) AS sc, count(*) AS c FROM (
  SELECT date, score_ew, fwd_rel_ret_1q AS y, row_number() OVER (PARTITION BY date ORDER BY round(score_ew,9), entity) AS k, count(*) OVER (PARTITION BY date) AS mm,
   quantile_cont(fwd_rel_ret_1q,0.01) OVER (PARTITION BY date) AS lo, quantile_cont(fwd_rel_ret_1q,0.99) OVER (PARTITION BY date) AS hi
  FROM scored WHERE index_name='SMALL' AND score_ew IS NOT NULL AND fwd_rel_ret_1q IS NOT NULL) WHERE mm>=20 GROUP BY 1,2) GROUP BY 1""",
        "scored",
    ),
)
def score_calibration_table(spark, sf):
    return tidy(ev.calibration_table(graded(spark, sf), "score_ew", "fwd_rel_ret_1q", large=v.large(spark, sf)))


@query(
    "flag_event_study",
    with_views(
        """SELECT cohort, CAST(g.k AS BIGINT) AS k, round(m,6) AS mean_rel_ret, round(se,6) AS se, round(mw,6) AS mean_rel_ret_w,
 round(CASE WHEN m IS NOT NULL THEN sum(m) OVER (PARTITION BY cohort ORDER BY g.k) END,6) AS cum_mean, coalesce(n,0) AS n
 FROM (SELECT unnest(range(4)) AS k) g CROSS JOIN (SELECT unnest(['all','entrant']) AS cohort) LEFT JOIN (
  SELECT cohort AS c2, k AS k2, avg(y) AS m, CASE WHEN count(*)>1 THEN stddev_samp(y)/sqrt(count(*)) END AS se, avg(CASE WHEN c>=10 THEN least(greatest(y,lo),hi) ELSE y END) AS mw, count(*) AS n FROM (
   SELECT *, quantile_cont(y,0.01) OVER w AS lo, quantile_cont(y,0.99) OVER w AS hi, count(*) OVER w AS c FROM (
    SELECT f.cohort, k.k, p.fwd_rel_ret_1q AS y FROM (
      SELECT a.entity, a.period_no, 'all' AS cohort FROM q a WHERE decile_ew=10 UNION ALL
      SELECT a.entity, a.period_no, 'entrant' FROM q a JOIN q b ON a.entity=b.entity AND b.period_no=a.period_no-1 WHERE a.decile_ew=10 AND b.decile_ew<>10) f
    CROSS JOIN (SELECT unnest(range(4)) AS k) k JOIN q p ON p.entity=f.entity AND p.period_no=f.period_no+k.k WHERE p.fwd_rel_ret_1q IS NOT NULL)
   WINDOW w AS (PARTITION BY cohort, k)) GROUP BY 1,2) ON c2=cohort AND k2=g.k""",
        "scored", extra={"q": "SELECT * FROM scored WHERE index_name='SMALL'"},
    ),
)
def flag_event_study(spark, sf):
    return tidy(ev.event_study(graded(spark, sf, "period_no"), "decile_ew", "fwd_rel_ret_1q", large=v.large(spark, sf, "lineitem")))


@query(
    "risk_reliability_table",
    with_views(
        """SELECT risk_decile, round(avg(p20),6) AS p_loss20, round(avg(p50),6) AS p_loss50, round(avg(m),6) AS mean_abs_ret, round(avg(md),6) AS median_abs_ret, CAST(sum(c) AS BIGINT) AS n_obs, count(*) AS n_dates FROM (
 SELECT date, CAST(least(greatest(ceil(round(risk_pct,9)/10.0),1),10) AS BIGINT) AS risk_decile, avg(CASE WHEN y<=-0.20 THEN 1.0 ELSE 0.0 END) AS p20, avg(CASE WHEN y<=-0.50 THEN 1.0 ELSE 0.0 END) AS p50,
  avg(y) AS m, median(y) AS md, count(*) AS c FROM (SELECT date, risk_pct, fwd_ret_1q AS y FROM risked WHERE risk_pct IS NOT NULL AND fwd_ret_1q IS NOT NULL) GROUP BY 1,2) GROUP BY 1""",
        "risked",
    ),
)
def risk_reliability_table(spark, sf):
    return tidy(ev.risk_reliability(v.risked(spark, sf), "fwd_ret_1q", large=v.large(spark, sf)))


# --- segments ------------------------------------------------------------------------------

_ERA = "SELECT date, avg(n_factors_used) AS avg_factors, CASE WHEN avg(n_factors_used)>=4 THEN 'full factor' ELSE 'price only' END AS era FROM scored GROUP BY 1"


@query("coverage_eras", with_views("SELECT date, round(avg_factors,6) AS avg_factors, era FROM er", "scored", extra={"er": _ERA}))
def coverage_eras(spark, sf):
    return tidy(ev.coverage_eras(v.scored(spark, sf)))


@query(
    "ic_by_era",
    with_views(
        f"SELECT era, round(mean,6) AS mean_ic, {r6('t_stat', 'ir')}, n_periods FROM ({hac_sql('t', 'era', 'ic', '1')})", "scored",
        extra={**IC1, "er": _ERA, "t": "SELECT ics.date, ic, era FROM ics JOIN er USING (date)", "h": hac_cte("t", "era", "ic", "1")},
    ),
)
def ic_by_era(spark, sf):
    eras = ev.coverage_eras(v.scored(spark, sf))
    return tidy(ev.ic_by_segment(ics(spark, sf), eras, "era", 1), "era", "mean_ic", "t_stat", "ir", "n_periods")


@query("ic_by_year", with_views("SELECT year(date) AS year, round(avg(ic),6) AS mean_ic, count(*) AS n_periods FROM ics GROUP BY 1", "scored", extra=IC1))
def ic_by_year(spark, sf):
    return tidy(ev.ic_by_year(ics(spark, sf)))


_VOL = """SELECT date, CASE WHEN count(r) OVER w >= 12 THEN stddev_samp(r) OVER w * sqrt(52.0) END AS vol FROM (SELECT *, close/lag(close) OVER (ORDER BY date)-1 AS r FROM bench)
 WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""


@query(
    "ic_by_volatility_regime",
    with_views(
        f"SELECT m.regime, round(mean,6) AS mean_ic, {r6('t_stat')}, n_periods, round(v.avg_vol,6) AS avg_bench_vol FROM ({hac_sql('t', 'regime', 'ic', '1')}) m JOIN (SELECT regime, avg(vol) AS avg_vol FROM t GROUP BY 1) v ON v.regime=m.regime",
        "scored", "bench",
        extra={
            **IC1, "vol": _VOL,
            "iv": "SELECT * FROM (SELECT ics.date, ic, vol, count(*) OVER () AS n FROM ics ASOF JOIN vol ON ics.date >= vol.date WHERE vol IS NOT NULL) WHERE n>=12",
            "t": "SELECT date, ic, vol, CASE WHEN round(vol,12)<=round(c1,12) THEN 'calm' WHEN round(vol,12)<=round(c2,12) THEN 'normal' ELSE 'stressed' END AS regime FROM iv CROSS JOIN (SELECT quantile_cont(vol,1/3.0) AS c1, quantile_cont(vol,2/3.0) AS c2 FROM iv)",
            "h": hac_cte("t", "regime", "ic", "1"),
        },
    ),
)
def ic_by_volatility_regime(spark, sf):
    from ..operators.asof import asof_join

    b = v.bench(spark, sf).join(F.broadcast(v.sessions(spark, sf)), "date")
    vol = ev.trailing_volatility(b, v.MID, v.LONG).select(F.lit("bench").alias("entity"), F.col("date").alias("as_of"), "vol")
    # one row per date
    dated = asof_join(v.kept(ics(spark, sf)).withColumn("entity", F.lit("bench")), vol, "date", "as_of", ["vol"]).where(F.col("vol").isNotNull())
    tagged = ev.terciles(ev.enough_periods(dated.select("date", "ic", "vol"), 12), "vol")
    res = ev.hac_mean(tagged, ["regime"], "ic", 1)
    avg = tagged.groupBy("regime").agg(F.avg("vol").alias("avg_bench_vol"))
    return tidy(res.join(avg, "regime").withColumnRenamed("mean", "mean_ic"), "regime", "mean_ic", "t_stat", "n_periods", "avg_bench_vol")


@query(
    "trailing_benchmark_volatility",
    with_views("SELECT date, round(vol,6) AS vol FROM vol", "bench", extra={"vol": _VOL}),
)
def trailing_benchmark_volatility(spark, sf):
    b = v.bench(spark, sf).join(F.broadcast(v.sessions(spark, sf)), "date")
    return tidy(ev.trailing_volatility(b, v.MID, v.LONG), "date", "vol")


@query(
    "rolling_family_ic",
    with_views(
        "SELECT series, date, round(CASE WHEN count(ic) OVER w>=6 THEN avg(ic) OVER w END,6) AS rolling_ic FROM ics WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)",
        "scored", extra={"ics": ic_sql("scored", FAM, Q1, SEL)},
    ),
)
def rolling_family_ic(spark, sf):
    return tidy(ev.rolling_mean_ic(ics(spark, sf, FAM), 12))


_WIN = " UNION ALL ".join(f"SELECT '{n}' AS name, DATE '{s}' AS start, DATE '{e}' AS \"end\"" for n, s, e in STRESS)


@query(
    "stress_window_table",
    with_views(
        """SELECT w.name, w.start, w."end", (SELECT round(avg(ic),6) FROM ics WHERE date BETWEEN w.start AND w."end") AS mean_ic, (SELECT count(*) FROM ics WHERE date BETWEEN w.start AND w."end") AS n_periods,
 (SELECT round(avg(spread),6) FROM sp WHERE date BETWEEN w.start AND w."end") AS spread_mean,
 (SELECT round(CASE WHEN count(*)>1 THEN arg_max(close,date)/arg_min(close,date)-1 END,6) FROM bench WHERE date BETWEEN w.start AND w."end") AS bench_return FROM win w""",
        "scored", "bench", extra={**IC1, "y": _Y, "sp": _SPREAD, "win": _WIN},
    ),
)
def stress_window_table(spark, sf):
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).cast("date").alias("start"), F.lit(e).cast("date").alias("end")) for n, s, e in STRESS]))
    win = spark.range(1).select(rows.alias("w")).select("w.*")
    d = graded(spark, sf)
    spreads = ev.decile_spread(d, "decile_ew", "fwd_rel_ret_1q")
    by_date = ev.ic_series(d, EW, Q1, large=v.large_selected(spark, sf))
    return tidy(ev.stress_windows(win, by_date, spreads, v.bench(spark, sf)))


@query(
    "sleeve_exposures",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{t}' AS metric, round(avg(w),6) AS flagged, round(avg(u),6) AS universe FROM (SELECT date, avg(CASE WHEN decile_ew=10 THEN {t} END) AS w, avg({t}) AS u FROM scored WHERE decile_ew IS NOT NULL GROUP BY 1)"
            for t in ("f_px", "f_qty", "f_disc")
        )
        + " UNION ALL SELECT 'largest sector share', round(avg(w),6), round(avg(u),6) FROM (SELECT date, max(cw)/nullif(sum(cw),0) AS w, max(cu)/sum(cu) AS u FROM (SELECT date, sector, count(*) FILTER (decile_ew=10) AS cw, count(*) AS cu FROM scored WHERE decile_ew IS NOT NULL GROUP BY 1,2) GROUP BY 1)",
        "scored",
    ),
)
def sleeve_exposures(spark, sf):
    return tidy(ev.exposures(v.kept(v.scored(spark, sf), "date", "entity", "sector", "decile_ew", "f_px", "f_qty", "f_disc"), "decile_ew", ["f_px", "f_qty", "f_disc"]))


# --- evidence-weighted blend ----------------------------------------------------------------

_FAMS = list(v.FAMILIES)
_W_MIN = 12
_ICW = {
    "fic": ic_sql("scored_m", FAM, Q1, SEL),
    "wk": f"""SELECT date, family, n, greatest(coalesce(m,0),0) AS pos, min(n) OVER (PARTITION BY date) AS n_realized, sum(greatest(coalesce(m,0),0)) OVER (PARTITION BY date) AS total FROM (
 SELECT d.date, f.family, count(ic) AS n, avg(ic) AS m FROM (SELECT DISTINCT date FROM scored_m) d CROSS JOIN (SELECT unnest({_FAMS!r}) AS family) f LEFT JOIN LATERAL (
  SELECT ic FROM fic WHERE fic.series=f.family AND fic.date <= CAST(d.date - INTERVAL 3 MONTH AS DATE) ORDER BY fic.date DESC LIMIT 36) ON true GROUP BY 1,2)""",
    "wt": f"SELECT date, family, CASE WHEN n_realized<{_W_MIN} OR total<=0 THEN 1.0/3 ELSE 0.5/3+0.5*pos/total END AS weight, n_realized FROM wk",
    "ww": "SELECT date, " + ", ".join(f"max(CASE WHEN family='{g}' THEN weight END) AS w_{g.lower()}" for g in _FAMS) + " FROM wt GROUP BY 1",
    "raw": "SELECT s.*, CASE WHEN n_factors_used>=3 AND n_families_used>=2 THEN ("
    + "+".join(f"CASE WHEN {fam(g)} IS NOT NULL THEN {fam(g)}*w_{g.lower()} ELSE 0 END" for g in _FAMS)
    + ")/("
    + "+".join(f"CASE WHEN {fam(g)} IS NOT NULL THEN w_{g.lower()} ELSE 0 END" for g in _FAMS)
    + ") END AS score_icw_raw FROM scored_m s JOIN ww USING (date)",
    "icw": f"SELECT *, {decile_sql('score_icw', 'decile_icw')} FROM (SELECT *, {z_sql('score_icw_raw', 'score_icw')} FROM raw)",
}
#: The same on the panel that also has the learned score.
_ICW_ML = {**_ML_M, **_ICW, "raw": _ICW["raw"].replace("FROM scored_m s", "FROM ml s")}


def blended(spark, sf, base=None):
    """Monthly scores weighted by the realised evidence of three years, equal until a year of it is there."""
    if base is None:
        base = v.kept(v.scored(spark, sf, "month"), "date", "entity", "sector", "index_name", *FAM.values(), "n_factors_used", "n_families_used", "score_ew", "fwd_rel_ret_1q")
    bound = v.large_selected(spark, sf, ev.ranks_held(len(_FAMS) + 1))
    return scoring.evidence_weighted_score(base, _FAMS, "fwd_rel_ret_1q", 3, v.SELECTION, large=bound, large_peers=v.large_peers(spark, sf))


@query("evidence_weight_history", with_views("SELECT date, family, round(weight,6) AS weight, n_realized FROM wt", "scored_m", extra={k: _ICW[k] for k in ("fic", "wk", "wt")}))
def evidence_weight_history(spark, sf):
    return tidy(blended(spark, sf)[1])


@query("evidence_weighted_score", with_views(f"SELECT date, entity, {r6('score_icw')}, {big('decile_icw')} FROM icw", "scored_m", extra=_ICW))
def evidence_weighted_score(spark, sf):
    return tidy(blended(spark, sf)[0], "date", "entity", "score_icw", "decile_icw")


_THREE = {"score_ew": "score_ew", "score_icw": "score_icw", "score_ml": "score_ml"}
_LAG_1Q = str(LAGS_M["1q"])


def _contenders(spark, sf):
    base = learned(spark, sf, "entity", "sector", *FAM.values(), "n_factors_used", "n_families_used", "score_ew")
    return blended(spark, sf, cheap(base.drop(*ML), base))[0]


@query(
    "model_comparison",
    with_views(
        f"SELECT series AS score_col, round(mean,6) AS mean_ic, {r6('t_stat', 'ir', 'hit_rate')}, n_periods FROM ({hac_sql('ics', 'series, horizon', 'ic', _LAG_1Q)})", "scored_m",
        extra={**_ICW_ML, "ics": ic_sql("icw", _THREE, Q1, SEL), "h": hac_cte("ics", "series, horizon", "ic", _LAG_1Q)},
    ),
)
def model_comparison(spark, sf):
    s = ev.ic_summary(_contenders(spark, sf), _THREE, Q1, {"1q": 3}, "M", large=v.large_selected(spark, sf, ev.ranks_held(len(_THREE) + 1)))
    return tidy(s.withColumnRenamed("series", "score_col"), "score_col", "mean_ic", "t_stat", "ir", "hit_rate", "n_periods")


_PAIR = {
    **_ML_M, "ics": ic_sql("ml", {"score_ml": "score_ml", "score_ew": "score_ew"}, Q1, SEL),
    "df": "SELECT a.date, a.ic-b.ic AS diff, 1 AS one FROM ics a JOIN ics b ON a.date=b.date WHERE a.series='score_ml' AND b.series='score_ew'",
    "h": hac_cte("df", "one", "diff", _LAG_1Q),
}


def _paired(spark, sf):
    # one row per date and series
    two = {"score_ml": "score_ml", "score_ew": "score_ew"}
    d = v.kept(ev.ic_series(learned(spark, sf, "entity", "score_ew"), two, Q1, large=v.large_selected(spark, sf, ev.ranks_held(len(two) + 1))))
    return ev.paired_test(d, "score_ml", "score_ew", LAGS_M["1q"])


@query(
    "paired_ic_test",
    with_views(f"SELECT round(mean,6) AS mean_diff, {r6('t_stat')}, n_periods, mean>0 AND t_stat>=1.645 AS promote FROM ({hac_sql('df', 'one', 'diff', _LAG_1Q)})", "scored_m", extra=_PAIR),
)
def paired_ic_test(spark, sf):
    return tidy(_paired(spark, sf))


@query(
    "promotion_with_hysteresis",
    with_views(
        f"""SELECT round(mean,6) AS mean_diff, was_promoted, CASE WHEN was_promoted THEN t_stat>=0 ELSE mean>0 AND t_stat>=1.645 END AS promote,
 CASE WHEN was_promoted AND t_stat>=0 THEN 'retained (hysteresis)' WHEN was_promoted THEN 'demoted' WHEN mean>0 AND t_stat>=1.645 THEN 'promoted' ELSE 'baseline kept' END AS decision,
 CASE WHEN CASE WHEN was_promoted THEN t_stat>=0 ELSE mean>0 AND t_stat>=1.645 END THEN 'score_ml' ELSE 'score_ew' END AS default_score
 FROM ({hac_sql('df', 'one', 'diff', _LAG_1Q)}) CROSS JOIN (SELECT unnest([true,false]) AS was_promoted)""",
        "scored_m", extra=_PAIR,
    ),
)
def promotion_with_hysteresis(spark, sf):
    p = v.kept(_paired(spark, sf))
    both = ev.promotion_decision(p, F.lit(True)).unionByName(ev.promotion_decision(p, F.lit(False)))
    return tidy(both, "mean_diff", "was_promoted", "promote", "decision", "default_score")


# --- transitions ------------------------------------------------------------------------------

_QD = {
    "qd": "SELECT DISTINCT max(date) OVER (PARTITION BY date_trunc('quarter', date)) AS date FROM (SELECT DISTINCT date FROM scored_m)",
    "cal": "SELECT date, row_number() OVER (ORDER BY date) AS i FROM qd",
    "q": "SELECT s.*, i FROM scored_m s JOIN cal USING (date) WHERE decile_ew IS NOT NULL",
}


def _months(spark, sf):
    return v.kept(v.scored(spark, sf, "month"), "date", "entity", "sector", "decile_ew")


@query("quarter_end_subset", with_views("SELECT date, count(*) AS n FROM scored_m JOIN qd USING (date) GROUP BY 1", "scored_m", extra={"qd": _QD["qd"]}))
def quarter_end_subset(spark, sf):
    return calendar.quarter_end_subset(_months(spark, sf)).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "decile_transition_matrix",
    with_views(
        """SELECT CAST(a.f AS BIGINT) AS from_decile, CAST(b.t AS BIGINT) AS to_decile, coalesce(n,0) AS n, round(coalesce(coalesce(n,0)/nullif(sum(coalesce(n,0)) OVER (PARTITION BY a.f),0),0),6) AS row_prob
 FROM (SELECT unnest(range(1,11)) AS f) a CROSS JOIN (SELECT unnest(range(1,11)) AS t) b LEFT JOIN (
 SELECT x.decile_ew AS fd, y.decile_ew AS td, count(*) AS n FROM q x JOIN q y ON x.entity=y.entity AND y.i=x.i+1 GROUP BY 1,2) ON fd=a.f AND td=b.t""",
        "scored_m", extra=_QD,
    ),
)
def decile_transition_matrix(spark, sf):
    return tidy(reporting.transition_matrix(_months(spark, sf), "decile_ew"))


@query(
    "flag_churn",
    with_views(
        """SELECT * FROM (SELECT entity, max(CASE WHEN i=top THEN sector END) AS sector, CAST(max(CASE WHEN i=top THEN decile_ew END) AS BIGINT) AS decile, CAST(max(CASE WHEN i=top-1 THEN decile_ew END) AS BIGINT) AS prev_decile,
 CASE WHEN max(CASE WHEN i=top THEN decile_ew END)>=9 AND coalesce(max(CASE WHEN i=top-1 THEN decile_ew END),0)<9 THEN 'newly_flagged'
      WHEN max(CASE WHEN i=top-1 THEN decile_ew END)>=9 AND max(CASE WHEN i=top THEN decile_ew END)<9 THEN 'exited' END AS change
 FROM q CROSS JOIN (SELECT max(i) AS top FROM q) WHERE i>=top-1 GROUP BY entity) WHERE change IS NOT NULL""",
        "scored_m", extra=_QD,
    ),
)
def flag_churn(spark, sf):
    return tidy(reporting.flag_churn(_months(spark, sf), "decile_ew"))


# --- sleeves -------------------------------------------------------------------------------------


def _sleeve(cond: str, tag: str) -> dict[str, str]:
    return {
        f"{tag}_h": f"SELECT date, entity, fwd_ret_1q AS r FROM scored WHERE index_name='SMALL' AND fwd_ret_1q IS NOT NULL AND decile_ew IS NOT NULL AND {cond} AND date < (SELECT max(date) FROM scored WHERE index_name='SMALL')",
        f"{tag}_d": f"SELECT date, avg(r) AS gross, count(*) AS n, row_number() OVER (ORDER BY date) AS i FROM {tag}_h GROUP BY 1",
        f"{tag}_w": f"SELECT h.entity, d.i, 1.0/d.n AS w FROM {tag}_h h JOIN {tag}_d d USING (date)",
        f"{tag}_t": f"SELECT i, 0.5*sum(abs(coalesce(wa,0)-coalesce(wb,0))) AS turnover FROM (SELECT coalesce(a.i, b.i+1) AS i, a.w AS wa, b.w AS wb FROM {tag}_w a FULL JOIN {tag}_w b ON a.entity=b.entity AND a.i=b.i+1) GROUP BY 1",
        tag: f"SELECT date, gross, turnover, gross-turnover*10.0/1e4 AS ret, n FROM {tag}_d JOIN {tag}_t USING (i)",
    }


_ALL, _AVOID = _sleeve("true", "allp"), _sleeve("decile_ew<10", "avoid")
_BQ = {
    "qdates": "SELECT DISTINCT date FROM scored WHERE index_name='SMALL'",
    "bq": "SELECT date, lead(close) OVER (ORDER BY date)/close-1 AS bench_ret FROM (SELECT q.date, b.close FROM qdates q ASOF LEFT JOIN bench b ON q.date >= b.date) QUALIFY lead(date) OVER (ORDER BY date) IS NOT NULL",
}


def _sel(spark, sf):
    return selected(v.scored(spark, sf))


def _sleeves(spark, sf):
    return portfolio.run_sleeves(_sel(spark, sf), "decile_ew", portfolio.standard_sleeves("decile_ew"))


def _bq(spark, sf):
    from ..operators.asof import benchmark_period_returns

    return benchmark_period_returns(v.bench(spark, sf), _sel(spark, sf).select("date"))


@query("sleeve_hold_all", with_views(f"SELECT date, {r6('gross', 'turnover', 'ret')}, n FROM allp", "scored", extra=_ALL))
def sleeve_hold_all(spark, sf):
    return tidy(portfolio.hold_all(_sel(spark, sf), "decile_ew"))


@query("sleeve_avoid_worst", with_views(f"SELECT date, {r6('gross', 'turnover', 'ret')}, n FROM avoid", "scored", extra=_AVOID))
def sleeve_avoid_worst(spark, sf):
    return tidy(portfolio.avoid_worst(_sel(spark, sf), "decile_ew"))


@query("benchmark_period_returns", with_views(f"SELECT date, {r6('bench_ret')} FROM bq", "scored", "bench", extra=_BQ))
def benchmark_period_returns(spark, sf):
    return tidy(_bq(spark, sf))


_CURVE = "SELECT *, equity/peak-1 AS drawdown FROM (SELECT *, max(equity) OVER (ORDER BY date) AS peak FROM (SELECT date, {r} AS ret, product(1+{r}) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM {t}))"


def _metrics_sql(curve: str) -> str:
    return f"""SELECT round(product(1+ret)-1,6) AS total_return, round(CASE WHEN product(1+ret)>0 THEN power(product(1+ret),4.0/count(*))-1 END,6) AS cagr, round(stddev_samp(ret)*2,6) AS vol,
 round(CASE WHEN stddev_samp(ret)*2>1e-12 THEN avg(ret)*4/(stddev_samp(ret)*2) END,6) AS sharpe, round(min(drawdown),6) AS max_drawdown, count(*) AS n_quarters FROM {curve}"""


@query("sleeve_equity_curve", with_views(f"SELECT date, {r6('equity', 'peak', 'drawdown')} FROM c", "scored", extra={**_AVOID, "c": _CURVE.format(r="ret", t="avoid")}))
def sleeve_equity_curve(spark, sf):
    from ..operators.timeseries import cumulative_growth

    return tidy(cumulative_growth(portfolio.avoid_worst(_sel(spark, sf), "decile_ew")), "date", "equity", "peak", "drawdown")


@query("sleeve_metrics", with_views(_metrics_sql("c"), "scored", extra={**_AVOID, "c": _CURVE.format(r="ret", t="avoid")}))
def sleeve_metrics(spark, sf):
    return tidy(portfolio.metrics(portfolio.avoid_worst(_sel(spark, sf), "decile_ew")))


@query("benchmark_metrics", with_views(_metrics_sql("c"), "scored", "bench", extra={**_BQ, "bqn": "SELECT * FROM bq WHERE bench_ret IS NOT NULL", "c": _CURVE.format(r="bench_ret", t="bqn")}))
def benchmark_metrics(spark, sf):
    return tidy(portfolio.metrics(portfolio.benchmark_sleeve(_bq(spark, sf))))


@query(
    "sleeve_versus_benchmark",
    with_views(
        """SELECT round(avg(CASE WHEN ret>bench_ret THEN 1.0 ELSE 0.0 END),6) AS hit_rate_vs_bench,
 round((SELECT power(product(1+ret),4.0/count(*))-1 FROM avoid) - (power(product(1+bench_ret),4.0/count(*))-1),6) AS excess_cagr FROM avoid JOIN bq USING (date) WHERE bench_ret IS NOT NULL""",
        "scored", "bench", extra={**_AVOID, **_BQ},
    ),
)
def sleeve_versus_benchmark(spark, sf):
    return tidy(portfolio.versus_benchmark(portfolio.avoid_worst(_sel(spark, sf), "decile_ew"), _bq(spark, sf)))


@query(
    "sleeve_relative_metrics",
    with_views(
        """SELECT round((power(product(1+a.ret),4.0/count(*))-1)-(power(product(1+b.ret),4.0/count(*))-1),6) AS excess_cagr_vs_base, round(stddev_samp(a.ret-b.ret)*2,6) AS tracking_error,
 round(avg(a.ret-b.ret)*4/(stddev_samp(a.ret-b.ret)*2),6) AS ir_vs_base, round(avg(CASE WHEN a.ret-b.ret>0 THEN 1.0 ELSE 0.0 END),6) AS hit_rate_vs_base, count(*) AS n_quarters FROM avoid a JOIN allp b ON a.date=b.date""",
        "scored", extra={**_AVOID, **_ALL},
    ),
)
def sleeve_relative_metrics(spark, sf):
    return tidy(portfolio.relative_metrics(_sleeves(spark, sf), "avoid_worst", "hold_all"))


@query(
    "sleeves_by_year",
    with_views(
        """SELECT coalesce(a.y,b.y) AS year, avoid_worst, avoid_worst_n, hold_all, hold_all_n FROM (SELECT year(date) AS y, round(product(1+ret)-1,6) AS avoid_worst, count(*) AS avoid_worst_n FROM avoid GROUP BY 1) a
 FULL JOIN (SELECT year(date) AS y, round(product(1+ret)-1,6) AS hold_all, count(*) AS hold_all_n FROM allp GROUP BY 1) b ON a.y=b.y""",
        "scored", extra={**_AVOID, **_ALL},
    ),
)
def sleeves_by_year(spark, sf):
    return tidy(portfolio.by_year(_sleeves(spark, sf), ["avoid_worst", "hold_all"]))


@query(
    "sleeves_by_regime",
    with_views(
        """SELECT CASE WHEN bench_ret>0 THEN 'benchmark up' ELSE 'benchmark down' END AS regime, count(*) AS n_quarters, round(avg(a.ret),6) AS avoid_worst, round(avg(b.ret),6) AS hold_all, round(avg(bench_ret),6) AS benchmark
 FROM bq LEFT JOIN avoid a ON a.date=bq.date LEFT JOIN allp b ON b.date=bq.date WHERE bench_ret IS NOT NULL GROUP BY 1""",
        "scored", "bench", extra={**_AVOID, **_ALL, **_BQ},
    ),
)
def sleeves_by_regime(spark, sf):
    return tidy(portfolio.by_regime(_sleeves(spark, sf), ["avoid_worst", "hold_all"], _bq(spark, sf)))


# --- estimation ---------------------------------------------------------------------------------

def featured(spark, sf):
    return v.kept(v.crossed(spark, sf), "date", "entity", "sector", "index_name", "fwd_rel_ret_1q", *ML)


def _moment_sql() -> str:
    cols = [f"coalesce({c},0)" for c in ML]
    parts = ["count(*) AS n", "round(sum(fwd_rel_ret_1q),6) AS sy"]
    parts += [f"round(sum({c}),6) AS sx_{i}" for i, c in enumerate(cols)]
    parts += [f"round(sum({c}*fwd_rel_ret_1q),6) AS sxy_{i}" for i, c in enumerate(cols)]
    parts += [f"round(sum({cols[i]}*{cols[j]}),6) AS sxx_{i}_{j}" for i in range(len(cols)) for j in range(i, len(cols))]
    return f"SELECT date, {', '.join(parts)} FROM x WHERE index_name='SMALL' AND fwd_rel_ret_1q IS NOT NULL GROUP BY 1"


@query("training_moments_by_date", with_views(_moment_sql(), "scored", extra={"x": f"SELECT *, {IX} FROM scored"}))
def training_moments_by_date(spark, sf):
    m = learning.date_moments(featured(spark, sf), ML, "fwd_rel_ret_1q", F.col("index_name") == v.SELECTION)
    return tidy(m.drop("syy").where(F.col("n") > 0))


@query(
    "walk_forward_ridge_scores",
    with_views(
        f"SELECT date, entity, round(score_ml,6) AS score_ml, CAST(decile_ml AS BIGINT) AS decile_ml FROM (SELECT *, {decile_sql('score_ml', 'decile_ml')} FROM "
        f"(SELECT x.date, entity, sector, index_name, {_FITTED} AS score_ml FROM x LEFT JOIN co ON co.date=x.date))",
        "scored", extra=_WALK,
    ),
)
def walk_forward_ridge_scores(spark, sf):
    d, _ = learning.walk_forward(featured(spark, sf), ML, "fwd_rel_ret_1q", F.col("index_name") == v.SELECTION)
    from ..operators.peers import peer_decile

    return tidy(peer_decile(d, "score_ml", "decile_ml", large=v.large_peers(spark, sf)), "date", "entity", "score_ml", "decile_ml")


_ONE = {
    "m": "SELECT date, count(y) AS n, coalesce(sum(y),0) AS sy, coalesce(sum(x),0) AS sx, coalesce(sum(x*y),0) AS sxy, coalesce(sum(x*x),0) AS sxx FROM (SELECT date, CASE WHEN index_name='SMALL' THEN fwd_rel_ret_1q END AS y, CASE WHEN index_name='SMALL' AND fwd_rel_ret_1q IS NOT NULL THEN coalesce(f_ret__n,0) END AS x FROM scored) GROUP BY 1",
    "tr": "SELECT date, row_number() OVER (ORDER BY date)-1 AS prior, " + ", ".join(f"sum({c}) OVER p AS {c}" for c in ("n", "sy", "sx", "sxy", "sxx")) + " FROM m WINDOW p AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "co": "SELECT date, w, sy/n-w*sx/n AS b FROM (SELECT *, (sxy-sx*sy/n)/(sxx-sx*sx/n+10.0) AS w FROM tr WHERE prior>=6 AND n>=50)",
}


@query("walk_forward_one_factor", with_views("SELECT s.date, s.entity, round(-(b+w*coalesce(f_ret__n,0)),6) AS score_ml FROM scored s LEFT JOIN co ON co.date=s.date", "scored", extra=_ONE))
def walk_forward_one_factor(spark, sf):
    d = v.kept(v.scored(spark, sf), "date", "entity", "index_name", "f_ret__n", "fwd_rel_ret_1q")
    out, _ = learning.walk_forward(d, ["f_ret__n"], "fwd_rel_ret_1q", F.col("index_name") == v.SELECTION)
    return tidy(out, "date", "entity", "score_ml")


@query(
    "walk_forward_coefficients",
    with_views(" UNION ALL ".join(f"SELECT date, '{f.removesuffix('__n')}' AS feature, round(w_{i},6) AS coef FROM co" for i, f in enumerate(ML)), "scored", extra=_WALK),
)
def walk_forward_coefficients(spark, sf):
    return tidy(learning.walk_forward(featured(spark, sf), ML, "fwd_rel_ret_1q", F.col("index_name") == v.SELECTION)[1])


def _logistic(spark, sf):
    return learning.walk_forward_logistic(featured(spark, sf), ML, "fwd_rel_ret_1q", F.col("index_name") == v.SELECTION)


@query("walk_forward_logistic_scores")
def walk_forward_logistic_scores(spark, sf):
    """Every row with its probability of a bottom-quartile outcome; tested against a plain solver."""
    return tidy(_logistic(spark, sf), "date", "entity", "score_ml")


@query(
    "logistic_variant_coverage",
    with_views(
        f"""SELECT date, n_rows, CASE WHEN prior>=6 AND (SELECT count(*) FROM scored t {SEL} AND t.date<d.date AND fwd_rel_ret_1q IS NOT NULL)>=50 THEN n_rows ELSE 0 END AS n_scored, true AS in_range
 FROM (SELECT date, count(*) AS n_rows, row_number() OVER (ORDER BY date)-1 AS prior FROM scored GROUP BY date) d""",
        "scored",
    ),
)
def logistic_variant_coverage(spark, sf):
    """Every row comes back; those of dates without enough history have no score, and scores are probabilities."""
    ok = F.coalesce(F.bool_and(F.col("score_ml").between(0, 1)), F.lit(True))
    return _logistic(spark, sf).groupBy("date").agg(F.count("*").alias("n_rows"), F.count("score_ml").alias("n_scored"), ok.alias("in_range"))


@query(
    "in_sample_ceiling",
    with_views(
        f"SELECT round(mean,6) AS mean_ic, {r6('t_stat')}, n_periods FROM ({hac_sql('ics', 'series', 'ic', '1')})",
        "scored",
        extra={
            **_WHOLE, "fit": f"SELECT x.*, {_FITTED} AS is_score FROM x CROSS JOIN co WHERE index_name='SMALL'",
            "ics": ic_sql("fit", {"is_score": "is_score"}, Q1), "h": hac_cte("ics", "series", "ic", "1"),
        },
    ),
)
def in_sample_ceiling(spark, sf):
    d = selected(featured(spark, sf))
    s = learning.in_sample(d, ML, "fwd_rel_ret_1q")
    return tidy(ev.ic_summary(s, {"is_score": "is_score"}, Q1, {"1q": 3}, "Q", large=v.large(spark, sf)), "mean_ic", "t_stat", "n_periods")


# --- resampling -------------------------------------------------------------------------------------


def _drawn_from(spark, sf):
    return v.kept(_sel(spark, sf), "date", "entity", "decile_ew", "fwd_ret_1q")


_POOL = (
    "SELECT tier, date, entity, ret FROM (SELECT date, entity, fwd_ret_1q AS ret, unnest(list_filter([CASE WHEN decile_ew<=10 THEN 'full' END, CASE WHEN decile_ew<=9 THEN 'ex10' END, CASE WHEN decile_ew<=8 THEN 'ex9_10' END, CASE WHEN decile_ew<=5 THEN 'top_half' END], lambda x: x IS NOT NULL)) AS tier"
    " FROM scored WHERE index_name='SMALL' AND decile_ew IS NOT NULL AND fwd_ret_1q IS NOT NULL AND date IN (SELECT date FROM scored WHERE index_name='SMALL' AND decile_ew IS NOT NULL AND fwd_ret_1q IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (decile_ew<=5)>=20))"
)
_STEP = "1 + CAST('0x' || substr(md5(concat_ws('|', 42, tier, date, trial, i)),1,8) AS BIGINT) % i"
_SLEEVES = {
    "pool": _POOL,
    "placed": "SELECT *, row_number() OVER (PARTITION BY tier, date ORDER BY entity) AS pos FROM pool",
    "sizes": "SELECT tier, date, count(*) AS size FROM pool GROUP BY 1,2",
    "steps": f"SELECT *, {_STEP} AS drawn FROM (SELECT tier, date, trial, step, size - 20 + step AS i FROM sizes CROSS JOIN range(1000) t(trial) CROSS JOIN range(1, 21) s(step))",
    "wide": "SELECT tier, date, trial, list(i ORDER BY step) AS i, list(drawn ORDER BY step) AS d FROM steps GROUP BY 1,2,3",
    "floyd": "SELECT tier, date, trial, unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(range(1, 21), lambda k: [i[k], d[k]])), lambda a, x: list_append(a, CASE WHEN list_contains(a, x[2]) THEN x[1] ELSE x[2] END))) AS pos FROM wide",
    "draws": "SELECT tier, trial, date, avg(ret) AS ret FROM floyd JOIN placed USING (tier, date, pos) GROUP BY 1,2,3",
    "paths": "SELECT tier, trial, date, product(1+ret) OVER (PARTITION BY tier, trial ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity, count(*) OVER (PARTITION BY tier, trial) AS n FROM draws",
}
_PCT = ", ".join(f"round(quantile_cont({{0}},{p / 100}),6) AS p{p}" for p in resampling.PERCENTILES)


def _paths_of_sleeves(spark, sf):
    pools = resampling.tier_pools(_drawn_from(spark, sf), "decile_ew")
    return resampling.sleeve_paths(resampling.random_sleeves(pools, large=v.large(spark, sf)))


@query(
    "random_sleeve_distribution",
    with_views(
        f"SELECT tier, {_PCT.format('cagr')}, round(avg(cagr),6) AS mean, round(avg(CASE WHEN cagr > (SELECT median(cagr) FROM cagr WHERE tier='full') THEN 1.0 ELSE 0.0 END),6) AS prob_beat_full_median, count(*) AS n_trials FROM cagr GROUP BY 1",
        "scored", extra={**_SLEEVES, "cagr": "SELECT tier, trial, power(arg_max(equity, date), 4.0/max(n)) - 1 AS cagr FROM paths GROUP BY 1,2 HAVING max(n)>=4"},
    ),
)
def random_sleeve_distribution(spark, sf):
    return tidy(resampling.sleeve_distribution(_paths_of_sleeves(spark, sf)))


@query("random_sleeve_equity_bands", with_views(f"SELECT tier, date, {_PCT.format('equity')} FROM paths GROUP BY 1,2", "scored", extra=_SLEEVES))
def random_sleeve_equity_bands(spark, sf):
    return tidy(resampling.equity_bands(_paths_of_sleeves(spark, sf)))


@query(
    "screening_tier_pools",
    with_views(
        f"SELECT tier, date, count(*) AS n, round(avg(ret),6) AS mean_ret FROM ({_POOL}) GROUP BY 1,2",
        "scored",
    ),
)
def screening_tier_pools(spark, sf):
    p = resampling.tier_pools(_drawn_from(spark, sf), "decile_ew")
    return tidy(p.groupBy("tier", "date").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret")))


def _corr_sql(key: str, source: str) -> str:
    return f"""SELECT {key}, -covar_pop(rs,ry)/(stddev_pop(rs)*stddev_pop(ry)) AS ic FROM (SELECT *, rank() OVER (w ORDER BY s) + (count(*) OVER (PARTITION BY {key},date,s)-1)/2.0 AS rs,
 rank() OVER (w ORDER BY y) + (count(*) OVER (PARTITION BY {key},date,y)-1)/2.0 AS ry FROM {source} WINDOW w AS (PARTITION BY {key},date)) GROUP BY {key}, date HAVING count(*)>=10 AND stddev_pop(rs)>1e-12 AND stddev_pop(ry)>1e-12"""


@query(
    "placebo_permutation",
    with_views(
        "SELECT round(r.ic,6) AS real_ic, round(avg(m),6) AS placebo_ic_mean, round(stddev_pop(m),6) AS placebo_ic_std, 0.03::DOUBLE AS tolerance, abs(avg(m))<0.03 AND r.ic>avg(m) AS passed "
        "FROM (SELECT trial, avg(ic) AS m FROM per GROUP BY 1) CROSS JOIN (SELECT avg(ic) AS ic FROM ics) r GROUP BY r.ic",
        "scored",
        extra={
            **IC1,
            "d": f"SELECT date, entity, score_ew, round(fwd_rel_ret_1q,9) AS y, row_number() OVER (PARTITION BY date ORDER BY entity) AS k FROM scored {SEL}",
            "dealt": "SELECT trial, date, score_ew, row_number() OVER (PARTITION BY trial, date ORDER BY md5(concat_ws('|', 0, trial, date, entity)), entity) AS k FROM d CROSS JOIN range(10) t(trial)",
            "pairs": "SELECT trial, date, entity, round(dealt.score_ew,9) AS s, y FROM d JOIN dealt USING (date, k) WHERE dealt.score_ew IS NOT NULL AND y IS NOT NULL",
            "per": _corr_sql("trial", "pairs"),
        },
    ),
)
def placebo_permutation(spark, sf):
    d = v.kept(_sel(spark, sf), "date", "entity", "score_ew", "fwd_rel_ret_1q")
    return tidy(resampling.placebo(d, "score_ew", "fwd_rel_ret_1q", large=v.large_selected(spark, sf, resampling.HELD_ROWS)))


@query(
    "random_composite_null",
    with_views(
        "SELECT count(*) AS n_draws, round(max(r.ic),6) AS real_ic, round(avg(m),6) AS null_mean, round(quantile_cont(m,0.95),6) AS null_p95, round(avg(CASE WHEN m>=r.ic THEN 1.0 ELSE 0.0 END),6) AS p_value "
        "FROM (SELECT draw, avg(ic) AS m FROM per GROUP BY 1) CROSS JOIN (SELECT avg(ic) AS ic FROM ics) r",
        "scored",
        extra={
            **IC1,
            "masks": f"SELECT draw, i FROM (SELECT draw, i, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', 7, draw, i)), i) AS no, 3 + CAST('0x' || substr(md5(concat_ws('|', 7, draw)),1,8) AS BIGINT) % {len(v.FEATURES) - 2} AS size "
            f"FROM range(100) d(draw) CROSS JOIN range({len(v.FEATURES)}) f(i)) WHERE no<=size",
            "long": " UNION ALL ".join(f"SELECT date, entity, round(fwd_rel_ret_1q,9) AS y, {i} AS i, {f} AS x FROM scored {SEL} AND fwd_rel_ret_1q IS NOT NULL AND {f} IS NOT NULL" for i, f in enumerate(v.FEATURES)),
            "pairs": "SELECT draw, date, entity, y, round(sum(x)/count(x),9) AS s FROM long JOIN masks USING (i) GROUP BY 1,2,3,4",
            "per": _corr_sql("draw", "pairs"),
        },
    ),
)
def random_composite_null(spark, sf):
    d = v.kept(_sel(spark, sf), "date", "entity", "score_ew", "fwd_rel_ret_1q", *v.FEATURES)
    masks = resampling.factor_masks(spark, v.FEATURES, 100)
    null = resampling.random_composites(d, v.FEATURES, "fwd_rel_ret_1q", masks, large=v.large_selected(spark, sf, resampling.HELD_ROWS))
    real = ev.ic_series(d, EW, Q1, large=v.large_selected(spark, sf)).agg(F.avg("ic").alias("real_ic"))
    return tidy(resampling.null_summary(null, real))


@query(
    "base_rate_inputs",
    f"""SELECT e.p AS era_periods, e.p>=12 AS shown, CASE WHEN e.p>=12 THEN s.cum END AS cum_mean, s.nq AS n_quarters, s.n0 AS n
 FROM (SELECT coalesce(max(CASE WHEN era='full factor' THEN n_periods END),0) AS p FROM ({SQL['ic_by_era']}))e
 CROSS JOIN (SELECT arg_max(cum_mean,k) AS cum, count(*) AS nq, arg_min(n,k) AS n0 FROM ({SQL['flag_event_study']}) WHERE cohort='entrant') s""",
)
def base_rate_inputs(spark, sf):
    d = v.kept(v.scored(spark, sf), "date", "entity", "index_name", "period_no", "score_ew", "decile_ew", "n_factors_used", "fwd_rel_ret_1q")
    eras = ev.ic_by_segment(ev.ic_series(selected(d), EW, Q1, large=v.large(spark, sf)), ev.coverage_eras(d), "era", 1)
    study = ev.event_study(selected(d), "decile_ew", "fwd_rel_ret_1q", large=v.large(spark, sf, "lineitem"))
    return tidy(reporting.base_rate(eras, study))
