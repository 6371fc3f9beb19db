"""Trailing features, point-in-time lookups, labels and statements on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio
from ..operators import asof, calendar, checks, fundamentals as fu, labels, reconcile, reporting, timeseries as ts
from . import views as v
from .reference_sql import VIEWS, with_views
from .registry import big, query, r6, tidy

S, M, L = v.SHORT, v.MID, v.LONG


def _grid(spark, sf):
    return ts.session_returns(ts.dense_grid(v.bars(spark, sf), v.sessions(spark, sf)))


def _mkt(spark, sf):
    return ts.market_returns(v.bench(spark, sf), v.sessions(spark, sf))


def frame(n: int, part: str = "entity") -> str:
    return f"(PARTITION BY {part} ORDER BY session_no RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def off(col: str, k: int) -> str:
    side = f"{-k} PRECEDING AND {-k} PRECEDING" if k < 0 else f"{k} FOLLOWING AND {k} FOLLOWING"
    return f"max({col}) OVER (PARTITION BY entity ORDER BY session_no RANGE BETWEEN {side})"


_FEAT = {
    "mm": f"SELECT *, CASE WHEN count(mkt) OVER q>={M} THEN avg(mkt) OVER q END AS mq, CASE WHEN count(mkt) OVER q>={M} THEN var_pop(mkt) OVER q END AS vq, "
    f"CASE WHEN count(mkt) OVER y>={L} THEN avg(mkt) OVER y END AS my, CASE WHEN count(mkt) OVER y>={L} THEN var_pop(mkt) OVER y END AS vy FROM mkt "
    f"WINDOW q AS (ORDER BY session_no ROWS BETWEEN {M-1} PRECEDING AND CURRENT ROW), y AS (ORDER BY session_no ROWS BETWEEN {L-1} PRECEDING AND CURRENT ROW)",
    "g": "SELECT grid.*, mm.mkt, mq, vq, my, vy, ret*mkt AS xm, CASE WHEN close*volume<>0 THEN abs(ret)/(close*volume) END AS il FROM grid LEFT JOIN mm USING (session_no)",
    "g2": f"""SELECT entity, date, {off('close', -S)}/{off('close', -L)}-1 AS mom_12_1, close/{off('close', -S)}-1 AS reversal_1m,
 close/CASE WHEN count(close) OVER y>={L} THEN max(close) OVER y END AS high_52w, CASE WHEN count(ret) OVER m>={S} THEN max(ret) OVER m END AS max_ret_1m,
 (CASE WHEN count(xm) OVER y>={L} THEN avg(xm) OVER y END - CASE WHEN count(ret) OVER y>={L} THEN avg(ret) OVER y END*my)/vy AS beta_252d,
 (CASE WHEN count(xm) OVER q>={M} THEN avg(xm) OVER q END - CASE WHEN count(ret) OVER q>={M} THEN avg(ret) OVER q END*mq)/vq AS b63, vq,
 CASE WHEN count(ret) OVER q>={M} THEN var_pop(ret) OVER q END AS vi, CASE WHEN count(il) OVER q>={S} THEN avg(il) OVER q END*1e9 AS amihud_63d
 FROM g WINDOW m AS {frame(S)}, q AS {frame(M)}, y AS {frame(L)}""",
}
FEATS = ["mom_12_1", "reversal_1m", "high_52w", "max_ret_1m", "beta_252d", "amihud_63d"]


@query(
    "trailing_price_features",
    with_views(
        f"SELECT entity, date, {r6(*FEATS)}, round(CASE WHEN vi IS NOT NULL AND b63 IS NOT NULL THEN sqrt(greatest(0,vi-b63*b63*vq)) END,6) AS ivol_63d FROM g2", "grid", "mkt", extra=_FEAT
    ),
)
def trailing_price_features(spark, sf):
    return tidy(ts.price_features(_grid(spark, sf), _mkt(spark, sf), S, M, L), "entity", "date", *FEATS, "ivol_63d")


@query("padded_session_returns", with_views("SELECT entity, date, round(ret,6) AS ret FROM grid", "grid"))
def padded_session_returns(spark, sf):
    return tidy(_grid(spark, sf), "entity", "date", "ret")


@query(
    "unpadded_session_returns",
    with_views(f"SELECT entity, date, round(close/{off('close', -1)}-1,6) AS ret FROM bars", "bars"),
)
def unpadded_session_returns(spark, sf):
    return tidy(ts.session_returns(v.bars(spark, sf), pad=False), "entity", "date", "ret")


@query(
    "forward_fill_bounded",
    with_views(
        """SELECT entity, date, last_value(close IGNORE NULLS) OVER (PARTITION BY entity ORDER BY session_no ROWS UNBOUNDED PRECEDING) AS filled,
 last_value(close IGNORE NULLS) OVER (PARTITION BY entity ORDER BY session_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS filled2 FROM grid""",
        "grid",
    ),
)
def forward_fill_bounded(spark, sf):
    g = ts.dense_grid(v.bars(spark, sf), v.sessions(spark, sf))
    return ts.carry_forward(ts.carry_forward(g, "close", "filled"), "close", "filled2", 2).select("entity", "date", "filled", "filled2")


@query("rebalance_dates", with_views("SELECT date, 'M' AS freq FROM rebal UNION ALL SELECT date, 'Q' FROM rebal_q", "rebal", "rebal_q"))
def rebalance_dates(spark, sf):
    cal = v.sessions(spark, sf)
    m, q = calendar.rebalance_dates(cal, "M"), calendar.rebalance_dates(cal, "Q")
    return m.withColumn("freq", F.lit("M")).unionByName(q.withColumn("freq", F.lit("Q")))


# --- flows on the event days ---------------------------------------------------------------

_FD = "FROM (SELECT DISTINCT user_id AS entity FROM events) e CROSS JOIN event_days d"


@query(
    "short_flow_features",
    with_views(
        f"""SELECT entity, date, round(l,6) AS short_vol_ratio, round(l-max(l) OVER (PARTITION BY entity ORDER BY session_no RANGE BETWEEN 6 PRECEDING AND 6 PRECEDING),6) AS short_vol_chg FROM (
 SELECT *, CASE WHEN count(ratio) OVER w>=3 THEN avg(ratio) OVER w END AS l FROM (SELECT e.entity, d.date, d.session_no, short_vol/total_vol AS ratio {_FD} LEFT JOIN flow f ON f.entity=e.entity AND f.date=d.date AND total_vol>0) WINDOW w AS {frame(6)})""",
        "flow", "event_days",
    ),
)
def short_flow_features(spark, sf):
    cal = v.event_days(spark, sf)
    ratio = calendar.with_sessions(ts.flow_ratio(v.flow(spark, sf)), cal)
    return tidy(ts.short_flow_features(ts.dense_grid(ratio, cal, ["ratio"]), 6, 3), "entity", "date", "short_vol_ratio", "short_vol_chg")


_NPR = f"""SELECT entity, date, CASE WHEN n>=5 AND b+s>0 THEN (b-s)/(b+s) END AS npr FROM (SELECT *, sum(buy) OVER w AS b, sum(sell) OVER w AS s, session_no+1 AS n FROM (
 SELECT e.entity, d.date, d.session_no, coalesce(buy_shares,0) AS buy, coalesce(sell_shares,0) AS sell FROM (SELECT DISTINCT entity FROM tr) e CROSS JOIN event_days d LEFT JOIN tr f ON f.entity=e.entity AND f.date=d.date
 WHERE d.date <= (SELECT max(date) FROM tr)) WINDOW w AS {frame(10)})"""
_TR = "SELECT * FROM flow WHERE buy_shares>0 OR sell_shares>0"


def _npr(spark, sf):
    traded = v.flow(spark, sf).where((F.col("buy_shares") > 0) | (F.col("sell_shares") > 0))
    return ts.net_purchase_ratio(traded, v.event_days(spark, sf), 10, 5)


@query("net_purchase_ratio", with_views("SELECT entity, date, round(npr,6) AS insider_npr_6m FROM np", "flow", "event_days", extra={"tr": _TR, "np": _NPR}))
def net_purchase_ratio(spark, sf):
    return tidy(_npr(spark, sf), "entity", "date", "insider_npr_6m")


@query(
    "exact_sample_then_carry",
    with_views(
        """SELECT n.entity, w.d0 AS date, round(npr,6) AS insider_npr_6m FROM np n JOIN (SELECT d0, least(d0, (SELECT max(date) FROM np)) AS d FROM (
 SELECT unnest([DATE '2024-01-07', DATE '2024-01-21', DATE '2024-01-29', DATE '2024-02-15']) AS d0)) w ON n.date=w.d""",
        "flow", "event_days", extra={"tr": _TR, "np": _NPR},
    ),
)
def exact_sample_then_carry(spark, sf):
    days = F.explode(F.array(*[F.lit(d).cast("date") for d in ("2024-01-07", "2024-01-21", "2024-01-29", "2024-02-15")]))
    return tidy(asof.sample_exact_then_carry(_npr(spark, sf), spark.range(1).select(days.alias("date")), ["insider_npr_6m"]))


_EV = {
    "ev": "SELECT entity, reaction_date FROM (SELECT *, date_diff('day', lag(reaction_date) OVER (PARTITION BY entity ORDER BY reaction_date), reaction_date) AS gap FROM (SELECT DISTINCT entity, reaction_date FROM signups)) WHERE gap IS NULL OR gap>2",
}


@query("repeat_events_dropped", with_views("SELECT entity, reaction_date FROM ev", "signups", extra=_EV))
def repeat_events_dropped(spark, sf):
    return ts.drop_close_repeats(v.signups(spark, sf), gap_days=2)


def _ship_events(spark, sf):
    """Brand events for the weekly bars: ship days of full lots that were returned."""
    li = v.table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50)).select("l_partkey", F.to_date("l_shipdate").alias("reaction_date"))
    part = v.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity"))
    return li.join(part, "l_partkey").select("entity", "reaction_date").distinct()


_REACT = {
    "ev0": "SELECT DISTINCT p_brand AS entity, CAST(l_shipdate AS DATE) AS reaction_date FROM lineitem JOIN part ON p_partkey=l_partkey WHERE l_returnflag='R' AND l_quantity=50",
    "evs": "SELECT entity, reaction_date, (SELECT min(session_no) FROM sessions s WHERE s.date>=reaction_date) AS r0 FROM ev0",
    "re": """SELECT entity, r0+1 AS session_no, arg_max(mv, reaction_date) AS reaction FROM (SELECT e.entity, e.r0, e.reaction_date, b1.close/b0.close-1-(m1.mkt_close/m0.mkt_close-1) AS mv FROM evs e
 JOIN bars b0 ON b0.entity=e.entity AND b0.session_no=e.r0-1 JOIN bars b1 ON b1.entity=e.entity AND b1.session_no=e.r0+1 JOIN mkt m0 ON m0.session_no=e.r0-1 JOIN mkt m1 ON m1.session_no=e.r0+1) GROUP BY 1,2""",
}


@query("next_session_lookup", with_views("SELECT entity, reaction_date, CAST(r0 AS BIGINT) AS r0 FROM evs WHERE r0 IS NOT NULL", "sessions", extra={k: _REACT[k] for k in ("ev0", "evs")}))
def next_session_lookup(spark, sf):
    return tidy(calendar.next_session(_ship_events(spark, sf), v.sessions(spark, sf), "reaction_date", "r0"), "entity", "reaction_date", "r0")


@query("event_reactions", with_views("SELECT entity, CAST(session_no AS BIGINT) AS session_no, round(reaction,6) AS reaction FROM re", "bars", "mkt", extra=_REACT))
def event_reactions(spark, sf):
    r = ts.event_reactions(_ship_events(spark, sf), v.bars(spark, sf), v.sessions(spark, sf), _mkt(spark, sf))
    return tidy(r, "entity", "session_no", "reaction")


@query(
    "event_reaction_with_expiry",
    with_views(
        """SELECT b.entity, CAST(b.session_no AS BIGINT) AS session_no, round(CASE WHEN b.session_no-r.session_no<=5 THEN reaction END,6) AS earn_react_1q FROM bars b ASOF LEFT JOIN re r ON b.entity=r.entity AND b.session_no>=r.session_no""",
        "bars", "mkt", extra=_REACT,
    ),
)
def event_reaction_with_expiry(spark, sf):
    b = v.bars(spark, sf)
    r = ts.event_reactions(_ship_events(spark, sf), b, v.sessions(spark, sf), _mkt(spark, sf))
    return tidy(ts.latest_reaction(r, b, 5))


# --- labels -------------------------------------------------------------------------------------


def _thin_bars(spark, sf):
    """Weekly bars per part: most weeks are gaps, many ratios are splices, some parts stop trading."""
    b = v.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("entity"), F.trunc(F.to_date("l_shipdate"), "week").alias("date")).agg(
        (F.round(F.sum("l_extendedprice"), 2) / F.sum("l_quantity")).alias("close")
    )
    return calendar.with_sessions(b, v.sessions(spark, sf))


_THIN = """SELECT entity, date, session_no, close FROM (SELECT l_partkey AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, round(sum(l_extendedprice),2)/sum(l_quantity) AS close
 FROM lineitem GROUP BY 1,2) JOIN sessions USING (date)"""
_ANOM = "SELECT * FROM (SELECT *, close/lag(close) OVER (PARTITION BY entity ORDER BY session_no) AS ratio FROM tb) WHERE ratio>4 OR ratio<0.25"


@query(
    "minimum_history",
    with_views("SELECT entity, count(*) AS n FROM tb WHERE entity IN (SELECT entity FROM tb GROUP BY 1 HAVING count(close)>=30) GROUP BY 1", "sessions", extra={"tb": _THIN}),
)
def minimum_history(spark, sf):
    return ts.long_enough(_thin_bars(spark, sf), 30).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("price_splices", with_views("SELECT entity, date, round(ratio,6) AS ratio, 'daily_jump' AS reason FROM an", "sessions", extra={"tb": _THIN, "an": _ANOM}))
def price_splices(spark, sf):
    return tidy(labels.price_anomalies(_thin_bars(spark, sf)), "entity", "date", "ratio", "reason")


def _fwd_sql(h: int) -> str:
    return f"""SELECT entity, date, CASE WHEN reason IS NOT NULL THEN NULL WHEN raw IS NULL AND p_now IS NOT NULL AND lv < top-15 AND lv > date AND lv < coalesce(tgt, date+{int(h * 1.5)}) THEN -1.0 ELSE raw END AS ret, reason,
 CASE WHEN reason IS NOT NULL THEN raw END AS excluded_value FROM (SELECT p.*, CASE WHEN raw IS NOT NULL AND an.session_no>p.session_no THEN 'splice_window'
 WHEN abs(raw)>3.5 THEN 'extreme_return' END AS reason FROM (
 SELECT pt.entity, pt.date, pt.session_no, pt.session_no+{h} AS win_end, n.close AS p_now, f.close/n.close-1 AS raw, l.lv, s.date AS tgt, (SELECT max(date) FROM sessions) AS top FROM pts pt
 ASOF LEFT JOIN tb n ON n.entity=pt.entity AND pt.session_no>=n.session_no LEFT JOIN tb f ON f.entity=pt.entity AND f.session_no=pt.session_no+{h}
 LEFT JOIN (SELECT entity, max(date) AS lv FROM tb GROUP BY 1) l ON l.entity=pt.entity LEFT JOIN sessions s ON s.session_no=pt.session_no+{h}) p ASOF LEFT JOIN an ON an.entity=p.entity AND p.win_end>=an.session_no)"""


_PTS = "SELECT e.entity, date, session_no FROM (SELECT DISTINCT entity FROM tb) e CROSS JOIN (SELECT date, session_no FROM sessions JOIN rebal USING (date))"
_FWD = {"tb": _THIN, "an": _ANOM, "pts": _PTS, "f1": _fwd_sql(12), "f2": _fwd_sql(24)}


def _points(spark, sf, b):
    cal = v.sessions(spark, sf)
    dates = calendar.with_sessions(calendar.rebalance_dates(cal, "M"), cal)
    every = F.broadcast(dates.agg(F.collect_list(F.struct("date", "session_no")).alias("__d")))  # a calendar
    e = b.select("entity").distinct().join(every, F.lit(True))
    return e.select("entity", F.explode("__d").alias("d")).select("entity", "d.date", "d.session_no")


_TWO = {"1q": 12, "2q": 24}


def _forward(spark, sf, horizons=None):
    b = _thin_bars(spark, sf)
    return labels.forward_returns(_points(spark, sf, b), b, v.sessions(spark, sf), horizons or _TWO, max_abs=3.5)


@query("gated_forward_returns", with_views("SELECT entity, date, round(ret,6) AS ret, reason, round(excluded_value,6) AS excluded_value FROM f1", "sessions", "rebal", extra={k: x for k, x in _FWD.items() if k != "f2"}))
def gated_forward_returns(spark, sf):
    f = _forward(spark, sf, {"1q": 12})
    return tidy(f.select("entity", "date", F.col("ret_1q").alias("ret"), F.col("reason_1q").alias("reason"), F.col("excluded_1q").alias("excluded_value")))


_XLOG = "SELECT date, entity, 1 AS horizon_q, reason, excluded_value AS value FROM f1 WHERE reason IS NOT NULL UNION ALL SELECT date, entity, 2, reason, excluded_value FROM f2 WHERE reason IS NOT NULL"


@query("label_exclusion_log", with_views(f"SELECT date, entity, {big('horizon_q')}, reason, {r6('value')} FROM x", "sessions", "rebal", extra={**_FWD, "x": _XLOG}))
def label_exclusion_log(spark, sf):
    return tidy(labels.exclusion_log(_forward(spark, sf), {"1q": 1, "2q": 2}))


@query("label_exclusion_summary", with_views("SELECT reason, count(*) AS n_labels, count(DISTINCT entity) AS n_entities FROM x GROUP BY 1", "sessions", "rebal", extra={**_FWD, "x": _XLOG}))
def label_exclusion_summary(spark, sf):
    return reporting.exclusion_summary(labels.exclusion_log(_forward(spark, sf), {"1q": 1, "2q": 2}))


@query("delisted_flag", with_views("SELECT f1.entity, f1.date, coalesce(f1.ret=-1.0,false) OR coalesce(f2.ret=-1.0,false) AS delisted FROM f1 JOIN f2 ON f1.entity=f2.entity AND f1.date=f2.date", "sessions", "rebal", extra=_FWD))
def delisted_flag(spark, sf):
    return labels.delisted_flag(_forward(spark, sf), ["ret_1q", "ret_2q"]).select("entity", "date", "delisted")


@query("last_valid_sessions", with_views("SELECT entity, max(date) AS last_valid, CAST(max(session_no) AS BIGINT) AS last_session FROM tb GROUP BY 1", "sessions", extra={"tb": _THIN}))
def last_valid_sessions(spark, sf):
    return tidy(labels.last_sessions(_thin_bars(spark, sf)))


# --- point-in-time lookups -----------------------------------------------------------------------

_ASOF = "SELECT entity, as_of, max_by(struct_pack(o:=order_no, v:=value), order_no) AS r FROM order_facts GROUP BY 1,2"


@query(
    "asof_latest_fact",
    with_views(
        "SELECT q.entity, q.date, f.as_of, CAST(f.r.o AS BIGINT) AS order_no, f.r.v AS value FROM quarter_grid q ASOF LEFT JOIN f ON q.entity=f.entity AND q.date>=f.as_of", "quarter_grid", "order_facts", extra={"f": _ASOF}
    ),
)
def asof_latest_fact(spark, sf):
    return asof.asof_join(v.quarter_grid(spark, sf), v.order_facts(spark, sf), "date", "as_of", ["order_no", "value"], ["order_no"])


@query(
    "asof_price",
    with_views(
        "SELECT e.entity, r.date, b.date AS as_of, b.close FROM (SELECT DISTINCT entity FROM tb) e CROSS JOIN rebal r ASOF LEFT JOIN tb b ON b.entity=e.entity AND r.date>=b.date", "sessions", "rebal", extra={"tb": _THIN}
    ),
)
def asof_price(spark, sf):
    b = _thin_bars(spark, sf)
    return asof.asof_price(_points(spark, sf, b).select("entity", "date"), b)


@query("has_membership_history", with_views("SELECT count(DISTINCT start_date)>1 OR bool_or(end_date IS NOT NULL) OR bool_or(trim(delist_note)<>'') AS point_in_time FROM membership", "membership"))
def has_membership_history(spark, sf):
    return asof.has_history(v.membership(spark, sf))


@query(
    "members_by_date",
    with_views("SELECT r.date, m.entity, company, sector FROM membership m JOIN rebal_q r ON start_date<=r.date AND r.date<=coalesce(end_date, DATE '9999-12-31')", "membership", "rebal_q"),
)
def members_by_date(spark, sf):
    return asof.members_on(v.membership(spark, sf), calendar.rebalance_dates(v.sessions(spark, sf), "Q"))


@query(
    "members_of_snapshot_store",
    with_views("SELECT r.date, sector, count(*) AS n FROM membership m JOIN rebal_q r ON true GROUP BY 1,2", "membership", "rebal_q"),
)
def members_of_snapshot_store(spark, sf):
    snap = v.membership(spark, sf).withColumn("start_date", F.lit("2001-11-01").cast("date")).withColumn("end_date", F.lit(None).cast("date"))
    m = asof.members_on(snap, calendar.rebalance_dates(v.sessions(spark, sf), "Q"))
    return m.groupBy("date", "sector").agg(F.count(F.lit(1)).alias("n"))


@query(
    "member_index_labels",
    """SELECT o.entity, coalesce(label, 'CORE') AS index_name FROM (SELECT DISTINCT o_custkey AS entity FROM orders) o LEFT JOIN (SELECT c_custkey, 'RICH' AS label FROM customer WHERE c_acctbal>5000) ON c_custkey=o.entity""",
)
def member_index_labels(spark, sf):
    members = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity")).distinct()
    dim = v.table(spark, sf, "customer").where(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("entity"), F.lit("RICH").alias("index_name"))
    return asof.label_members(members, dim, "CORE")


@query(
    "latest_known_sector",
    "SELECT o_custkey AS entity, max_by(o_orderpriority, CAST(o_orderdate AS DATE)::VARCHAR||o_orderpriority) AS sector, max_by(o_orderstatus, CAST(o_orderdate AS DATE)::VARCHAR||o_orderstatus) AS company FROM orders GROUP BY 1",
)
def latest_known_sector(spark, sf):
    o = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("company"), F.col("o_orderpriority").alias("sector"), F.to_date("o_orderdate").alias("start_date")
    )
    return asof.latest_known_sector(o)


@query(
    "primary_with_fallback",
    """SELECT o_custkey AS entity, o_totalprice AS value FROM orders WHERE o_orderstatus='F' UNION ALL SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus='O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')""",
)
def primary_with_fallback(spark, sf):
    o = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    a, b = o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_orderstatus") == "O")
    return asof.prefer_primary(a, b).select("entity", "value")


@query(
    "windows_spanning_splices",
    with_views(
        "SELECT p.entity, p.date, coalesce(an.session_no>p.session_no, false) AS spanned FROM (SELECT *, session_no+12 AS win_end FROM pts) p ASOF LEFT JOIN an ON an.entity=p.entity AND p.win_end>=an.session_no", "sessions", "rebal",
        extra={"tb": _THIN, "an": _ANOM, "pts": _PTS},
    ),
)
def windows_spanning_splices(spark, sf):
    b = _thin_bars(spark, sf)
    w = _points(spark, sf, b).withColumn("win_end", F.col("session_no") + 12)
    return asof.spans_event(w, labels.price_anomalies(b), "session_no", "win_end", "session_no", "spanned").select("entity", "date", "spanned")


@query(
    "session_offset_prices",
    with_views("SELECT a.entity, a.date, b.close AS close_later FROM bars a LEFT JOIN bars b ON b.entity=a.entity AND b.session_no=a.session_no+4", "bars"),
)
def session_offset_prices(spark, sf):
    return v.bars(spark, sf).select("entity", "date", ts.at_offset("close", 4).alias("close_later"))


# --- statements --------------------------------------------------------------------------------------


@query(
    "trailing_four_and_yoy",
    with_views(
        """SELECT entity, quarter_end, CASE WHEN count(value) OVER w=4 THEN round(sum(value) OVER w,4) END AS ttm, round(value/lag(value,4) OVER o-1,6) AS yoy FROM (SELECT entity, quarter_end, max(value) AS value FROM order_facts GROUP BY 1,2)
 WINDOW o AS (PARTITION BY entity ORDER BY quarter_end), w AS (PARTITION BY entity ORDER BY quarter_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
        "order_facts",
    ),
)
def trailing_four_and_yoy(spark, sf):
    from pyspark.sql.window import Window

    d = v.order_facts(spark, sf).groupBy("entity", "quarter_end").agg(F.max("value").alias("value"))
    w = Window.partitionBy("entity").orderBy("quarter_end")
    d = d.select("entity", "quarter_end", F.round(fu.trailing_four("value"), 4).alias("ttm"), (safe_ratio("value", F.lag("value", 4).over(w)) - 1).alias("yoy"))
    return tidy(d)


_Q = """SELECT entity, "end", CASE WHEN month("start")=month("end")-2 THEN val ELSE val-lag(val) OVER (PARTITION BY entity, fy ORDER BY "end") END AS val, filed, lag("end") OVER (PARTITION BY entity, fy ORDER BY "end") AS pe, "start" FROM ytd"""


@query(
    "unwound_year_to_date",
    with_views(
        """SELECT entity, "end", round(val,2) AS val, filed FROM q WHERE (date_diff('day',"start","end") BETWEEN 60 AND 120) OR (pe IS NOT NULL AND date_diff('day',pe,"end") BETWEEN 60 AND 120)""",
        "ytd", extra={"q": _Q},
    ),
)
def unwound_year_to_date(spark, sf):
    return tidy(fu.quarterly_flow(v.ytd_facts(spark, sf)).select("entity", "end", "val", "filed"), digits=2)


_TAGS = {"revenue": ["Revenues", "SalesRevenueNet"], "net_income": ["NetIncomeLoss", "ProfitLoss"]}


def _tagged_orders(spark, sf):
    """Orders as facts: urgent ones under the preferred tag, others under an older one."""
    tag = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Revenues").when(F.col("o_orderpriority") == "2-HIGH", "SalesRevenueNet")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "NetIncomeLoss").otherwise("ProfitLoss")
    )
    d = F.to_date("o_orderdate")
    return v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity"), tag.alias("tag"), F.trunc(d, "quarter").alias("end"), d.alias("filed"), F.col("o_totalprice").alias("val")
    )


_FACTS = """SELECT o_custkey AS entity, CASE o_orderpriority WHEN '1-URGENT' THEN 'Revenues' WHEN '2-HIGH' THEN 'SalesRevenueNet' WHEN '3-MEDIUM' THEN 'NetIncomeLoss' ELSE 'ProfitLoss' END AS tag,
 CAST(date_trunc('quarter', o_orderdate) AS DATE) AS "end", CAST(o_orderdate AS DATE) AS filed, o_totalprice AS val FROM orders"""
_FF = 'SELECT entity, tag, "end", min(filed) AS filed, arg_min(val, epoch(filed)*1e7+val) AS val FROM fa GROUP BY 1,2,3'
_MG = """SELECT entity, item, "end", val, filed FROM (SELECT *, row_number() OVER (PARTITION BY entity, item, "end" ORDER BY rk) AS k FROM (
 SELECT *, CASE WHEN tag IN ('Revenues','SalesRevenueNet') THEN 'revenue' ELSE 'net_income' END AS item, CASE WHEN tag IN ('Revenues','NetIncomeLoss') THEN 0 ELSE 1 END AS rk FROM ff)) WHERE k=1"""


@query("first_filed_wins", with_views('SELECT entity, tag, "end", val, filed FROM ff', extra={"fa": _FACTS, "ff": _FF}))
def first_filed_wins(spark, sf):
    return fu.quarterly_stock(_tagged_orders(spark, sf))


@query("alias_merge_per_period", with_views("SELECT * FROM mg", extra={"fa": _FACTS, "ff": _FF, "mg": _MG}))
def alias_merge_per_period(spark, sf):
    return fu.merge_aliases(fu.quarterly_stock(_tagged_orders(spark, sf)), _TAGS)


@query(
    "knowledge_dates",
    with_views(
        """SELECT entity, "end" AS quarter_end, max(filed) AS as_of, max(CASE WHEN item='revenue' THEN val END) AS revenue, max(CASE WHEN item='net_income' THEN val END) AS net_income FROM mg GROUP BY 1,2""",
        extra={"fa": _FACTS, "ff": _FF, "mg": _MG},
    ),
)
def knowledge_dates(spark, sf):
    items = fu.merge_aliases(fu.quarterly_stock(_tagged_orders(spark, sf)), _TAGS)
    return fu.known_day(items).select("entity", "quarter_end", "as_of", "revenue", "net_income")


# Items of a supplier's quarter, from its line items.
_ITEMS_SQL = {
    "sq": """SELECT l_suppkey AS entity, last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS quarter_end, round(sum(l_extendedprice),4) AS revenue, round(sum(l_extendedprice*(1-l_discount)),4) AS gross_profit,
 round(sum(l_extendedprice*l_tax),4) AS net_income, round(sum(CASE WHEN l_returnflag='A' THEN l_extendedprice END),2) AS ebit, round(sum(CASE WHEN l_returnflag='N' THEN l_quantity END),2) AS dep_amort, round(sum(CASE WHEN l_linestatus='F' THEN l_extendedprice END),2) AS ocf,
 round(sum(CASE WHEN l_discount>0.08 THEN l_extendedprice END),2) AS capex, round(sum(l_quantity),2)*1000 AS total_assets, round(sum(CASE WHEN l_returnflag='R' THEN l_quantity END),2)*500 AS total_liabilities,
 round(sum(CASE WHEN l_linenumber=1 THEN l_quantity END),2) AS long_term_debt, round(sum(CASE WHEN l_linenumber=7 THEN l_quantity END),2) AS short_term_debt, count(*)*1.0::DOUBLE AS shares FROM lineitem GROUP BY 1,2""",
    "tt": "SELECT *, quarter_end+45 AS as_of, "
    + ", ".join(f"CASE WHEN count({c}) OVER w=4 THEN sum({c}) OVER w END AS {c}_ttm" for c in ("revenue", "gross_profit", "net_income", "ebit", "dep_amort", "ocf", "capex"))
    + " FROM sq WINDOW w AS (PARTITION BY entity ORDER BY quarter_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "fr": """SELECT *, ebit_ttm+abs(dep_amort_ttm) AS ebitda_ttm, ocf_ttm-abs(capex_ttm) AS fcf_ttm, CASE WHEN long_term_debt IS NOT NULL OR short_term_debt IS NOT NULL THEN coalesce(long_term_debt,0)+coalesce(short_term_debt,0) END AS total_debt,
 net_income_ttm/nullif(total_assets-total_liabilities,0) AS roe, net_income_ttm/nullif(total_assets,0) AS roa, gross_profit_ttm/nullif(revenue_ttm,0) AS gross_margin, (ocf_ttm-abs(capex_ttm))/nullif(revenue_ttm,0) AS fcf_margin, ocf_ttm/nullif(net_income_ttm,0) AS accruals_ocf_ni FROM tt""",
    "fy": """SELECT *, roe-lag(roe,4) OVER o AS roe_yoy, gross_margin-lag(gross_margin,4) OVER o AS gross_margin_yoy, total_assets/nullif(lag(total_assets,4) OVER o,0)-1 AS asset_growth_yoy, shares/nullif(lag(shares,4) OVER o,0)-1 AS net_issuance_yoy FROM fr
 WINDOW o AS (PARTITION BY entity ORDER BY as_of, quarter_end)""",
}
_ITEM_COLS = ("revenue", "gross_profit", "net_income", "ebit", "dep_amort", "ocf", "capex", "total_assets", "total_liabilities", "long_term_debt", "short_term_debt", "shares")
_FUND_OUT = ["roe", "roa", "gross_margin", "fcf_margin", "accruals_ocf_ni", "roe_yoy", "gross_margin_yoy", "asset_growth_yoy", "net_issuance_yoy"]


def supplier_items(spark, sf):
    """Statement items per supplier and quarter in long form, filed 45 days after quarter end."""
    li = v.table(spark, sf, "lineitem")
    x, q = F.col("l_extendedprice"), F.col("l_quantity")
    quarter_end = F.last_day(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 2))
    money = {
        "revenue": x, "gross_profit": x * (1 - F.col("l_discount")), "net_income": x * F.col("l_tax"), "ebit": F.when(F.col("l_returnflag") == "A", x),
        "dep_amort": F.when(F.col("l_returnflag") == "N", q), "ocf": F.when(F.col("l_linestatus") == "F", x), "capex": F.when(F.col("l_discount") > 0.08, x),
    }
    aggs = [F.round(F.sum(c), 4).alias(n) for n, c in money.items()]
    aggs += [
        (F.round(F.sum(q), 2) * 1000).alias("total_assets"), (F.round(F.sum(F.when(F.col("l_returnflag") == "R", q)), 2) * 500).alias("total_liabilities"),
        F.round(F.sum(F.when(F.col("l_linenumber") == 1, q)), 2).alias("long_term_debt"), F.round(F.sum(F.when(F.col("l_linenumber") == 7, q)), 2).alias("short_term_debt"),
        F.count(F.lit(1)).cast("double").alias("shares"),
    ]
    wide = li.groupBy(F.col("l_suppkey").alias("entity"), quarter_end.alias("end")).agg(*aggs)
    return wide.unpivot(["entity", "end"], list(_ITEM_COLS), "item", "val").where(F.col("val").isNotNull()).withColumn("filed", F.date_add("end", 45))


@query("fundamental_factors", with_views(f"SELECT entity, quarter_end, as_of, {r6(*_FUND_OUT)} FROM fy", extra=_ITEMS_SQL))
def fundamental_factors(spark, sf):
    return tidy(fu.factors_from_items(supplier_items(spark, sf)), "entity", "quarter_end", "as_of", *_FUND_OUT)


@query(
    "valuation_ratios",
    with_views(
        """SELECT entity, quarter_end, round(CASE WHEN net_income_ttm>0 THEN cap/net_income_ttm END,6) AS pe_ratio, round(CASE WHEN ebitda_ttm>0 THEN ev/ebitda_ttm END,6) AS ev_to_ebitda, round(CASE WHEN revenue_ttm>0 THEN cap/revenue_ttm END,6) AS ps_ratio,
 round(CASE WHEN ev>0 THEN fcf_ttm/ev END,6) AS fcf_yield FROM (SELECT *, CASE WHEN shares>0 THEN shares*s_acctbal END AS cap, CASE WHEN shares>0 THEN shares*s_acctbal+coalesce(total_debt,0) END AS ev FROM fy JOIN supplier ON s_suppkey=entity)""",
        extra=_ITEMS_SQL,
    ),
)
def valuation_ratios(spark, sf):
    price = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("close"))
    d = fu.valuation(fu.factors_from_items(supplier_items(spark, sf)).join(price, "entity"))
    return tidy(d, "entity", "quarter_end", "pe_ratio", "ev_to_ebitda", "ps_ratio", "fcf_yield")


# --- paths and merges -------------------------------------------------------------------------------------

_COHORT = {
    "co": """SELECT DISTINCT entity, 10 - (CAST(substr(entity, 7) AS BIGINT) % 2)*9 AS decile, (SELECT max(session_no) FROM sessions JOIN rebal_q USING (date) WHERE session_no+24 <= (SELECT max(session_no) FROM sessions)) AS base_no FROM bars""",
    "pth": """SELECT * FROM (SELECT c.entity, c.decile, CASE WHEN c.decile>=9 THEN 'bottom' ELSE 'top' END AS side, b.date, b.close/p.close-1-(m.mkt_close/m0.mkt_close-1) AS v, count(*) OVER (PARTITION BY c.entity) AS n FROM co c JOIN bars p ON p.entity=c.entity AND p.session_no=c.base_no
 JOIN bars b ON b.entity=c.entity AND b.session_no BETWEEN c.base_no AND c.base_no+24 JOIN mkt m ON m.session_no=b.session_no JOIN mkt m0 ON m0.session_no=c.base_no WHERE (b.session_no-c.base_no)%5=0 OR b.session_no-c.base_no=24) WHERE n>=2""",
}


def _paths(spark, sf):
    b, cal = v.bars(spark, sf), v.sessions(spark, sf)
    base = reporting.last_graded_date(calendar.rebalance_dates(cal, "Q"), cal, 24)
    side = F.lit(10) - (F.substring("entity", 7, 9).cast("int") % 2) * 9
    cohort = b.select("entity").distinct().join(F.broadcast(base.select("base_no")), F.lit(True)).withColumn("decile", side)
    return reporting.cohort_paths(cohort, b, cal, _mkt(spark, sf), 24)


@query("cohort_paths", with_views(f"SELECT entity, {big('decile')}, side, date, round(v,6) AS v FROM pth", "bars", "mkt", "rebal_q", extra=_COHORT))
def cohort_paths(spark, sf):
    return tidy(_paths(spark, sf))


@query(
    "cohort_median_path",
    with_views(
        "SELECT side, date, round(max(CASE WHEN k=n//2+1 THEN v END),6) AS median_v, max(n) AS n FROM (SELECT side, date, v, row_number() OVER (PARTITION BY side, date ORDER BY round(v,9), entity) AS k, count(*) OVER (PARTITION BY side, date) AS n FROM pth) GROUP BY 1,2",
        "bars", "mkt", "rebal_q", extra=_COHORT,
    ),
)
def cohort_median_path(spark, sf):
    return tidy(reporting.cohort_median(_paths(spark, sf), large=v.large(spark, sf)))


_MERGE = {
    "old": "SELECT entity, date, CASE WHEN entity IN ('Brand#3','Brand#4') THEN close/3 WHEN entity='Brand#5' THEN close*(1+session_no%3*0.1) ELSE close END AS close, volume FROM bars WHERE session_no<=330 AND entity<>'Brand#7'",
    "nw": "SELECT entity, date, close, volume FROM bars WHERE session_no BETWEEN 325 AND 356",
    "vd": """SELECT entity, med, CASE WHEN med<=0 THEN 'refetch' WHEN abs(med-1)<=0.005 THEN 'keep' WHEN (hi-lo)/med<=0.005 THEN 'rescale' ELSE 'refetch' END AS verdict FROM (
 SELECT entity, median(n.close/o.close) AS med, min(n.close/o.close) AS lo, max(n.close/o.close) AS hi, count(*) AS n FROM old o JOIN nw n USING (entity, date) WHERE o.close<>0 GROUP BY 1) WHERE n>=2""",
}


def _old_new(spark, sf):
    b = v.bars(spark, sf)
    e, s = F.col("entity"), F.col("session_no")
    scaled = F.when(e.isin("Brand#3", "Brand#4"), F.col("close") / 3).when(e == "Brand#5", F.col("close") * (1 + s % 3 * 0.1)).otherwise(F.col("close"))
    old = b.where((s <= 330) & (e != "Brand#7")).select("entity", "date", scaled.alias("close"), "volume")
    return old, b.where(s.between(325, 356)).select("entity", "date", "close", "volume")


@query("adjustment_verdicts", with_views(f"SELECT entity, {r6('med')}, verdict FROM vd", "bars", extra=_MERGE))
def adjustment_verdicts(spark, sf):
    return tidy(reconcile.adjustment_verdicts(*_old_new(spark, sf)))


@query(
    "reconciled_top_up",
    with_views(
        """SELECT entity, date, round(coalesce(n.close, o.close*coalesce(f.med,1.0)),10) AS close, coalesce(n.volume,o.volume) AS volume FROM (SELECT * FROM nw WHERE entity IN (SELECT entity FROM old)) n FULL JOIN old o USING (entity, date)
 LEFT JOIN (SELECT entity AS fe, med FROM vd WHERE verdict='rescale') f ON fe=entity""",
        "bars", extra=_MERGE,
    ),
)
def reconciled_top_up(spark, sf):
    old, new = _old_new(spark, sf)
    known = new.join(old.select("entity").distinct(), "entity", "left_semi")
    return tidy(reconcile.top_up(old, known)[0], digits=10)


@query("new_entities_appended", with_views("SELECT entity, count(*) AS n FROM (SELECT entity FROM old UNION ALL SELECT entity FROM nw WHERE entity NOT IN (SELECT entity FROM old)) GROUP BY 1", "bars", extra=_MERGE))
def new_entities_appended(spark, sf):
    return reconcile.add_new_entities(*_old_new(spark, sf)).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("degraded_window_guard", with_views("SELECT count(DISTINCT o.entity) AS known, count(DISTINCT n.entity) AS covered, count(DISTINCT n.entity) < count(DISTINCT o.entity)*0.5 AS degraded FROM old o LEFT JOIN nw n ON n.entity=o.entity", "bars", extra=_MERGE))
def degraded_window_guard(spark, sf):
    old, new = _old_new(spark, sf)
    return reconcile.degraded(new, old)


@query(
    "price_freshness",
    with_views(
        "SELECT max(date) AS last, CAST((SELECT count(*) FROM range((SELECT max(date) FROM bars), DATE '2001-11-09', INTERVAL 1 DAY) t(d) WHERE isodow(d)<6) AS BIGINT) AS stale, (SELECT count(*) FROM range((SELECT max(date) FROM bars), DATE '2001-11-09', INTERVAL 1 DAY) t(d) WHERE isodow(d)<6) <= 5 AS fresh FROM bars",
        "bars",
    ),
)
def price_freshness(spark, sf):
    return tidy(reconcile.freshness(v.bars_raw(spark, sf), "2001-11-09"))


# --- checks ---------------------------------------------------------------------------------------------------


_CHECKED = ["1996-01-01", "1997-03-03", "1997-09-01", "1998-06-01", "1999-02-01", "2000-01-03"]
_ALL_FEATS = [*FEATS, "ivol_63d"]


@query(
    "truncation_invariance",
    with_views(
        " UNION ALL ".join(
            f"SELECT date, '{f}' AS feature, count({x}) AS checked, CAST(0 AS BIGINT) AS mismatches FROM g2 WHERE date IN ("
            + ", ".join(f"DATE '{d}'" for d in _CHECKED) + ") GROUP BY date"
            for f, x in [*((f, f) for f in FEATS), ("ivol_63d", "CASE WHEN vi IS NOT NULL AND b63 IS NOT NULL THEN 1 END")]
        ),
        "grid", "mkt", extra=_FEAT,
    ),
)
def truncation_invariance(spark, sf):
    """All seven features at six dates, with the market series: no value may change when later bars are unknown."""
    cal, mkt = v.sessions(spark, sf), _mkt(spark, sf)

    def features(rows):
        return ts.price_features(ts.session_returns(ts.dense_grid(rows, cal)), mkt, S, M, L)

    return checks.truncation_invariance(v.bars(spark, sf), features, _ALL_FEATS, _CHECKED)


@query(
    "run_summary",
    with_views(
        """SELECT (SELECT max(date) FROM panel) AS latest_date, (SELECT count(DISTINCT date) FROM panel) AS n_cross_sections, (SELECT count(*) FROM panel) AS panel_rows, (SELECT count(*) FROM panel WHERE fwd_ret_1q < -0.2) AS n_delisted,
 (SELECT count(DISTINCT entity) FROM panel WHERE date=(SELECT max(date) FROM panel)) AS universe_size, (SELECT count(DISTINCT sector) FROM panel WHERE date=(SELECT max(date) FROM panel)) AS n_sectors, (SELECT max(date) FROM bars) AS prices_through""",
        "panel", "bars",
    ),
)
def run_summary(spark, sf):
    p = v.panel(spark, sf).withColumn("delisted", F.coalesce(F.col("fwd_ret_1q") < -0.2, F.lit(False)))
    return reporting.run_summary(p, v.bars(spark, sf))


@query("universe_floor", with_views("SELECT count(DISTINCT entity) AS n_names, count(DISTINCT entity)>=300 AS passed FROM panel WHERE date=(SELECT max(date) FROM panel)", "panel"))
def universe_floor(spark, sf):
    return reporting.universe_floor(calendar.latest_cross_section(v.panel(spark, sf)), 300)
