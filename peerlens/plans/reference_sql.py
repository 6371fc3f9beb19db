"""SQL statements of the same views, for checking results in another engine.

``with_views(body, *names)`` prefixes a query with the common table expressions it needs.
"""

from __future__ import annotations

from .views import FACTORS, FAMILIES, INTERACTIONS

WG = "PARTITION BY date, sector, index_name"


def _panel(unit: str) -> str:
    period = "year(date)*4+quarter(date)" if unit == "quarter" else "year(date)*12+month(date)"
    scale = 1 if unit == "quarter" else 3
    steps = {"1q": scale, "2q": 2 * scale, "4q": 4 * scale}
    if unit == "month":
        steps = {"1m": 1, **steps}
    fwd = ", ".join(
        f"max(px) OVER (PARTITION BY entity ORDER BY period_no RANGE BETWEEN {k} FOLLOWING AND {k} FOLLOWING)/px-1 AS fwd_ret_{n}"
        for n, k in steps.items()
    )
    rel = ", ".join(f"fwd_ret_{n} - median(fwd_ret_{n}) OVER ({WG}) AS fwd_rel_ret_{n}" for n in steps)
    return f"""
 SELECT *, {rel} FROM (SELECT *, {fwd} FROM (
  SELECT a.*, p_type AS sector, CASE WHEN p_size<=25 THEN 'SMALL' ELSE 'LARGE' END AS index_name, {period} AS period_no FROM (
   SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date, l_partkey AS entity,
    round(avg(l_discount),9) AS f_disc, round(avg(l_tax),9) AS f_tax,
    round(avg(CASE WHEN l_returnflag='R' THEN 1.0 ELSE 0.0 END),9) AS f_ret, round(sum(l_quantity),6) AS f_qty,
    round(ln(round(sum(l_extendedprice),2)/sum(l_quantity)),9) AS f_px, round(sum(l_extendedprice),2)/sum(l_quantity)+50000 AS px, CAST(count(*) AS DOUBLE) AS f_lines,
    CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS f_supp
   FROM lineitem GROUP BY 1,2) a JOIN part ON p_partkey=entity))"""


def neutral_sql(source: str, factors=FACTORS, keys: str = WG, suffix: str = "__n", floor: int = 5, pct: float = 0.02) -> str:
    fs = list(factors)
    q = ", ".join(
        f"quantile_cont({f},{pct}) OVER ({keys}) AS lo_{f}, quantile_cont({f},{1-pct}) OVER ({keys}) AS hi_{f}, count({f}) OVER ({keys}) AS c_{f}"
        for f in fs
    )
    w = ", ".join(
        f"CASE WHEN c_{f}>=3 AND {f} IS NOT NULL THEN least(greatest({f},lo_{f}),hi_{f}) ELSE {f} END AS w_{f}" for f in fs
    )
    m = ", ".join(f"avg(w_{f}) OVER ({keys}) AS mu_{f}, stddev_pop(w_{f}) OVER ({keys}) AS sd_{f}" for f in fs)
    z = ", ".join(
        f"(CASE WHEN sd_{f}>1e-12 THEN (w_{f}-mu_{f})/sd_{f} ELSE w_{f}*0.0 END)*{factors[f]} AS {f}{suffix}" for f in fs
    )
    drop = ", ".join(f"lo_{f}, hi_{f}, c_{f}, w_{f}, mu_{f}, sd_{f}" for f in fs)
    where = f"WHERE rows_ >= {floor}" if floor else ""
    return f"""
 SELECT * EXCLUDE (rows_, {drop}), {z} FROM (SELECT *, {m} FROM (SELECT *, {w} FROM (
  SELECT * FROM (SELECT *, count(*) OVER ({keys}) AS rows_, {q} FROM {source}) {where})))"""


def mean_sql(cols) -> str:
    s = "+".join(f"coalesce({c},0)" for c in cols)
    n = "+".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in cols)
    return f"(({s})/nullif(({n}),0))"


def count_sql(cols) -> str:
    return "(" + "+".join(f"(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in cols) + ")"


def fam(g: str) -> str:
    return f"fam_{g.lower()}__score"


def decile_sql(score: str, out: str, keys: str = WG, n: int = 10) -> str:
    """Row-level expression; needs the score column in scope."""
    return (
        f"CASE WHEN {score} IS NOT NULL THEN CAST(least(greatest((row_number() OVER ({keys}, ({score} IS NULL) ORDER BY round({score},9), entity)*{n}"
        f" + count(*) OVER ({keys}, ({score} IS NULL)) - 1) // count(*) OVER ({keys}, ({score} IS NULL)),1),{n}) AS INTEGER) END AS {out}"
    )


def z_sql(col: str, out: str, keys: str = WG) -> str:
    return (
        f"CASE WHEN stddev_pop({col}) OVER ({keys})>1e-12 THEN ({col}-avg({col}) OVER ({keys}))/stddev_pop({col}) OVER ({keys})"
        f" ELSE {col}*0.0 END AS {out}"
    )


def _scored(source: str) -> str:
    fams = ", ".join(f"{mean_sql([f + '__n' for f in fs])} AS {fam(g)}" for g, fs in FAMILIES.items())
    fcols = [fam(g) for g in FAMILIES]
    ncols = [f"{f}__n" for f in FACTORS]
    return f"""
 SELECT *, {decile_sql('score_ew', 'decile_ew')} FROM (SELECT *, {z_sql('score_ew_raw', 'score_ew')} FROM (
  SELECT *, CASE WHEN n_factors_used>=3 AND n_families_used>=2 THEN {mean_sql(fcols)} END AS score_ew_raw FROM (
   SELECT *, {count_sql(fcols)} AS n_families_used FROM (SELECT *, {fams}, {count_sql(ncols)} AS n_factors_used FROM {source}))))"""


def rank_pct_sql(v: str, keys: str, scale: str = "1.0") -> str:
    r = f"round({v},9)"
    return (
        f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER ({keys} ORDER BY {r} NULLS LAST) + (count(*) OVER ({keys}, {r}) - 1)/2.0)"
        f" / count({v}) OVER ({keys}) * {scale} END"
    )


def _risked(source: str) -> str:
    ts = [f"{f}__t" for f in FACTORS]
    return f"""
 SELECT *, CASE WHEN risk_pct IS NULL THEN 'Unknown' WHEN risk_pct<30 THEN 'Stable' WHEN risk_pct<70 THEN 'Mainstream' ELSE 'Elevated' END AS risk_tier
 FROM (SELECT *, {rank_pct_sql('risk_score', 'PARTITION BY date', '100.0')} AS risk_pct FROM (
  SELECT *, {count_sql(ts)} AS n_risk_used, {mean_sql(ts)} AS risk_score FROM ({neutral_sql(source, FACTORS, 'PARTITION BY date', '__t', 0)})))"""


IX = ", ".join(
    f"CASE WHEN stddev_pop({fam(a)}*{fam(b)}) OVER ({WG})>1e-12 THEN ({fam(a)}*{fam(b)}-avg({fam(a)}*{fam(b)}) OVER ({WG}))/stddev_pop({fam(a)}*{fam(b)}) OVER ({WG}) ELSE {fam(a)}*{fam(b)}*0.0 END AS {n}__n"
    for n, (a, b) in INTERACTIONS.items()
)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "panel": ((), _panel("quarter")),
    "panel_m": ((), _panel("month")),
    "neutral": (("panel",), neutral_sql("panel")),
    "neutral_m": (("panel_m",), neutral_sql("panel_m")),
    "scored": (("neutral",), _scored("neutral")),
    "scored_m": (("neutral_m",), _scored("neutral_m")),
    "risked": (("scored",), _risked("scored")),
    "sessions": (
        (),
        "SELECT date, row_number() OVER (ORDER BY date) - 1 AS session_no FROM (SELECT DISTINCT CAST(date_trunc('week', l_shipdate) AS DATE) AS date FROM lineitem)",
    ),
    "bars": (
        ("sessions",),
        """SELECT entity, date, session_no, close, volume FROM (SELECT p_brand AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  round(sum(l_extendedprice),2)/sum(l_quantity) AS close, round(sum(l_quantity),6) AS volume
  FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1,2) JOIN sessions USING (date)""",
    ),
    "bench": (
        (),
        "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, round(sum(l_extendedprice),2)/sum(l_quantity) AS close FROM lineitem GROUP BY 1",
    ),
    "grid": (
        ("bars", "sessions"),
        """SELECT e.entity, s.date, s.session_no, b.close, b.volume,
  last_value(b.close IGNORE NULLS) OVER (PARTITION BY e.entity ORDER BY s.session_no ROWS UNBOUNDED PRECEDING)
  / last_value(b.close IGNORE NULLS) OVER (PARTITION BY e.entity ORDER BY s.session_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS ret
  FROM (SELECT DISTINCT entity FROM bars) e CROSS JOIN sessions s LEFT JOIN bars b ON b.entity=e.entity AND b.session_no=s.session_no""",
    ),
    "mkt": (
        ("sessions", "bench"),
        """SELECT session_no, mkt_close, mkt_close/lag(mkt_close) OVER (ORDER BY session_no) - 1 AS mkt FROM (
  SELECT session_no, last_value(close IGNORE NULLS) OVER (ORDER BY session_no ROWS UNBOUNDED PRECEDING) AS mkt_close
  FROM sessions LEFT JOIN bench USING (date))""",
    ),
    "rebal": (("sessions",), "SELECT max(date) AS date FROM sessions GROUP BY date_trunc('month', date)"),
    "rebal_q": (("sessions",), "SELECT max(date) AS date FROM sessions GROUP BY date_trunc('quarter', date)"),
    "membership": (
        (),
        """SELECT o_custkey AS entity, c_name AS company, c_mktsegment AS sector, start_date,
  CASE WHEN date_diff('day', last, top) > 90 THEN last END AS end_date, '' AS delist_note FROM (
  SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS start_date, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1)
  CROSS JOIN (SELECT max(CAST(o_orderdate AS DATE)) AS top FROM orders) JOIN customer ON c_custkey=o_custkey""",
    ),
    "order_facts": (
        (),
        "SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) + 60 AS as_of, CAST(o_orderdate AS DATE) AS quarter_end, o_orderkey AS order_no, o_totalprice AS value FROM orders",
    ),
    "quarter_grid": (
        (),
        "SELECT DISTINCT o_custkey AS entity, last_day(CAST(o_orderdate AS DATE)) AS date FROM orders",
    ),
    "ytd": (
        (),
        """SELECT entity, 'Revenues' AS tag, CAST(date_trunc('year', q) AS DATE) AS start, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end",
  round(sum(flow) OVER (PARTITION BY entity, year(q) ORDER BY q),2) AS val, CAST(q + INTERVAL 3 MONTH AS DATE) + 29 AS filed, year(q) AS fy, flow
  FROM (SELECT l_suppkey AS entity, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, round(sum(l_extendedprice),2) AS flow FROM lineitem GROUP BY 1,2)""",
    ),
    "flow": (
        (),
        """SELECT user_id AS entity, CAST(ts AS DATE) AS date,
  round(sum(CASE WHEN event_type='purchase' THEN value ELSE 0.0 END),6) AS buy_shares, round(sum(CASE WHEN event_type='error' THEN value ELSE 0.0 END),6) AS sell_shares,
  round(sum(CASE WHEN event_type='view' THEN value ELSE 0.0 END),6) AS short_vol, round(sum(value),6) AS total_vol FROM events GROUP BY 1,2""",
    ),
    "event_days": (
        (),
        "SELECT date, row_number() OVER (ORDER BY date) - 1 AS session_no FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)",
    ),
    "signups": ((), "SELECT user_id AS entity, CAST(ts AS DATE) AS reaction_date FROM events WHERE event_type='signup'"),
}


def ic_sql(source: str, scores: dict[str, str], labels: dict[str, str], where: str = "", min_rows: int = 10, extra: str = "") -> str:
    """(series, horizon, date, ic, n): minus the Spearman correlation per date."""
    s = " UNION ALL ".join(
        f"SELECT date, entity, '{sn}' AS series, '{ln}' AS horizon, round({sc},9) AS s, round({lc},9) AS y FROM {source} {where}"
        for sn, sc in scores.items()
        for ln, lc in labels.items()
    )
    return f"""SELECT series, horizon, date, -covar_pop(rs,ry)/(stddev_pop(rs)*stddev_pop(ry)) AS ic, count(*) AS n FROM (
  SELECT *, rank() OVER (w ORDER BY s) + (count(*) OVER (PARTITION BY series,horizon,date,s)-1)/2.0 AS rs,
            rank() OVER (w ORDER BY y) + (count(*) OVER (PARTITION BY series,horizon,date,y)-1)/2.0 AS ry
  FROM ({s}) WHERE s IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY series,horizon,date))
 GROUP BY 1,2,3 HAVING count(*)>={min_rows} AND stddev_pop(rs)>1e-12 AND stddev_pop(ry)>1e-12"""


def hac_sql(source: str, keys: str, value: str, lags: str, order: str = "date") -> str:
    """Mean, Newey-West t, se, IR, hit rate, n per key by a lag self join; ``lags`` is an SQL expression."""
    return f"""SELECT {keys}, max(mean_) AS mean, CASE WHEN max(n_)>=3 AND sum(c)>1e-18 THEN max(mean_)/(sqrt(sum(c))/max(n_)) END AS t_stat,
  CASE WHEN max(n_)>=3 AND sum(c)>1e-18 THEN sqrt(sum(c))/max(n_) END AS se,
  CASE WHEN max(n_)>=3 AND max(sd_)>1e-12 THEN max(mean_)/max(sd_) END AS ir, max(hit_) AS hit_rate, max(n_) AS n_periods FROM (
  SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.mean_, a.n_, a.sd_, a.hit_,
   a.e*b.e*(1-abs(a.i-b.i)/(a.lag_+1.0)) AS c FROM h a JOIN h b ON {' AND '.join('a.' + k.strip() + '=b.' + k.strip() for k in keys.split(','))} AND abs(a.i-b.i)<=a.lag_)
 GROUP BY {keys}"""


def hac_cte(source: str, keys: str, value: str, lags: str, order: str = "date") -> str:
    return f"""h AS (SELECT *, {value}-avg({value}) OVER k AS e, avg({value}) OVER k AS mean_, count(*) OVER k AS n_, stddev_samp({value}) OVER k AS sd_,
  avg(CASE WHEN {value}>0 THEN 1.0 ELSE 0.0 END) OVER k AS hit_, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i, {lags} AS lag_
  FROM {source} WHERE {value} IS NOT NULL WINDOW k AS (PARTITION BY {keys}))"""


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the views it needs, dependencies first, then ``extra`` expressions."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            add(d)
        order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order]
    for n, sql in (extra or {}).items():
        parts.append(sql if n == "h" else f"{n} AS ({sql})")
    return f"WITH {', '.join(parts)} {body}" if parts else body
