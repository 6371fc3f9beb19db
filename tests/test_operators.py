"""Hand-computed edge cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from peerlens.functions import scalar as sc
from peerlens.operators import asof, calendar, checks, evaluation as ev, fundamentals as fu, labels, learning, peers, portfolio, reconcile, resampling, scoring, timeseries as ts

D = dt.date


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scalars(spark):
    d = frame(spark, [(D(2024, 1, 5), "2024-01-05T21:00:00.000Z"), (D(2024, 1, 5), ""), (D(2024, 7, 3), "2024-07-03T19:59:00.000Z")], "d date, a string")
    got = [r[0] for r in d.select(sc.reaction_day("d", "a")).collect()]
    assert got == [D(2024, 1, 8), D(2024, 1, 5), D(2024, 7, 3)]
    x = frame(spark, [(1.0, 0.0), (float("nan"), 2.0), (4.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in x.select(sc.safe_ratio("a", "b")).collect()] == [None, None, 2.0, None]
    span = frame(spark, [(D(2024, 1, 5), D(2024, 1, 8)), (D(2024, 1, 8), D(2024, 1, 5)), (D(2024, 1, 6), D(2024, 1, 7))], "a date, b date")
    for r in span.select("a", "b", sc.weekdays_between("a", "b").alias("n")).collect():
        assert r.n == int(np.busday_count(r.a, r.b)) or r.a > r.b and r.n == -int(np.busday_count(r.b, r.a))


def test_bins_match_their_definitions(spark):
    d = spark.range(1, 41).select(F.explode(F.sequence(F.lit(1), F.col("id").cast("int"))).alias("k"), F.col("id").cast("int").alias("m"))
    got = d.select("k", "m", sc.bucket_of(F.col("k"), F.col("m"), 10).alias("b")).collect()
    assert all(r.b == min(10, max(1, -(-r.k * 10 // r.m))) for r in got)
    got = d.where("m >= 20").select("k", "m", sc.quantile_bin(F.col("k"), F.col("m"), 10).alias("b")).collect()
    assert all(r.b == max(1, math.ceil((r.k - 1) * 10 / (r.m - 1))) for r in got)


def test_constant_missing_and_tiny_groups(spark):
    rows = [("a", i, 5.0, None) for i in range(6)] + [("b", 1, 1.0, 2.0)] + [("c", i, float(i), float(i % 2)) for i in range(6)]
    d = frame(spark, rows, "g string, entity int, x double, y double")
    z = {(r.g, r.entity): r for r in peers.neutralize(d, {"x": 1, "y": 1}, ["g"], large=False).collect()}
    assert all(k[0] != "b" for k in z)  # one row is below the floor
    assert z[("a", 0)]["x__n"] == 0.0 and z[("a", 0)]["y__n"] is None
    zs = [z[("c", i)]["x__n"] for i in range(6)]
    assert abs(sum(zs)) < 1e-9 and abs(np.std(zs) - 1) < 1e-9
    rho = ev.rank_correlation(d.select("g", "entity", F.col("x").alias("s"), F.col("entity").alias("y")), ["g"], large=False)
    got = {r.g: r.rho for r in rho.collect()}
    assert got["a"] is None and got["b"] is None and abs(got["c"] - 1) < 1e-12


def test_overlap_corrected_mean_matches_the_definition(spark):
    x = [0.1, 0.3, -0.2, 0.4, 0.0, 0.25, 0.05, -0.1]
    d = frame(spark, [("s", D(2020, 1, 1 + i), v) for i, v in enumerate(x)], "series string, date date, ic double")
    r = ev.hac_mean(d, ["series"], "ic", 3).first()
    e = np.array(x) - np.mean(x)
    s = (e @ e) + 2 * sum((1 - l / 4) * (e[l:] @ e[:-l]) for l in (1, 2, 3))
    assert r["t_stat"] == pytest.approx(np.mean(x) / (math.sqrt(s) / len(x)))
    assert r["ir"] == pytest.approx(np.mean(x) / np.std(x, ddof=1))
    short = ev.hac_mean(d.limit(2), ["series"], "ic", 1).first()
    assert short["t_stat"] is None and short["mean"] is not None


def weekdays(n, start=D(2021, 1, 1)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def test_name_that_stops_trading_is_carried_to_the_end(spark):
    days = weekdays(504)
    rows = [("SURV", d, 100 * 1.005**i) for i, d in enumerate(days)] + [("DEAD", d, 100 * 1.005**i) for i, d in enumerate(days) if i < 252]
    bars = frame(spark, rows, "entity string, date date, close double")
    cal = calendar.session_calendar(bars)
    stamped = calendar.with_sessions(bars, cal)
    pts = bars.select("entity").distinct().join(calendar.with_sessions(calendar.rebalance_dates(cal, "Q"), cal))
    fwd = labels.forward_returns(pts, stamped, cal, {"1q": 63})
    assert checks.delisting_carried(fwd.withColumnRenamed("ret_1q", "ret"), "DEAD").first()["passed"]
    surv = fwd.where("entity = 'SURV' and ret_1q is not null").select("ret_1q").collect()
    assert all(abs(r[0] - (1.005**63 - 1)) < 1e-9 for r in surv)


def test_splice_excludes_and_is_never_filled(spark):
    days = weekdays(40)
    px = [10.0] * 20 + [100.0] * 20
    bars = frame(spark, [("X", d, p) for d, p in zip(days, px)], "entity string, date date, close double")
    cal = calendar.session_calendar(bars)
    stamped = calendar.with_sessions(bars, cal)
    fwd = labels.forward_returns(stamped.select("entity", "date", "session_no"), stamped, cal, {"1q": 5})
    by = {r.date: r for r in fwd.collect()}
    assert by[days[17]]["reason_1q"] == "splice_window" and by[days[17]]["ret_1q"] is None
    assert by[days[14]]["reason_1q"] is None and by[days[14]]["ret_1q"] == 0.0  # target session 19 is before the jump
    assert by[days[20]]["reason_1q"] is None
    log = labels.exclusion_log(fwd, {"1q": 1}).collect()
    assert len(log) == 5 and all(abs(r.value - 9.0) < 1e-12 for r in log)


def test_gap_uses_up_a_session(spark):
    days = weekdays(6)
    rows = [("A", d, float(10 + i)) for i, d in enumerate(days) if i != 2] + [("B", d, 1.0) for d in days]
    bars = frame(spark, rows, "entity string, date date, close double")
    cal = calendar.session_calendar(bars)
    grid = ts.dense_grid(calendar.with_sessions(bars, cal), cal, ["close"])
    padded = {r.session_no: r.ret for r in ts.session_returns(grid).where("entity = 'A'").collect()}
    assert padded[2] == 0.0 and padded[3] == pytest.approx(13 / 11 - 1)
    bare = {r.session_no: r.ret for r in ts.session_returns(grid, pad=False).where("entity = 'A'").collect()}
    assert bare[2] is None and bare[3] is None
    lag = {r.session_no: r.x for r in grid.withColumn("x", ts.at_offset("close", -2)).where("entity = 'A'").collect()}
    assert lag[4] is None and lag[5] == 13.0


def test_asof_takes_the_whole_row_and_later_tie(spark):
    facts = frame(spark, [("A", D(2020, 1, 1), 1, 5.0), ("A", D(2020, 2, 1), 1, 6.0), ("A", D(2020, 2, 1), 2, None)], "entity string, as_of date, q int, v double")
    pts = frame(spark, [("A", D(2019, 12, 31)), ("A", D(2020, 1, 1)), ("A", D(2020, 3, 1)), ("B", D(2020, 3, 1))], "entity string, date date")
    got = {(r.entity, r.date): (r.as_of, r.v) for r in asof.asof_join(pts, facts, values=["v"], tie_break=["q"]).collect()}
    assert got[("A", D(2019, 12, 31))] == (None, None)
    assert got[("A", D(2020, 1, 1))] == (D(2020, 1, 1), 5.0)
    assert got[("A", D(2020, 3, 1))] == (D(2020, 2, 1), None)
    assert got[("B", D(2020, 3, 1))] == (None, None)


def test_reaction_expires(spark):
    r = frame(spark, [("A", 10, 0.5), ("A", 12, None)], "entity string, session_no int, reaction double")
    pts = spark.range(9, 90).select(F.lit("A").alias("entity"), F.col("id").cast("int").alias("session_no"))
    got = {x.session_no: x.earn_react_1q for x in ts.latest_reaction(r.where("reaction is not null"), pts).collect()}
    assert got[9] is None and got[10] == 0.5 and got[80] == 0.5 and got[81] is None


def test_events_measured_against_the_previous_one_kept_or_not(spark):
    ev_ = frame(spark, [("A", D(2020, 1, 1)), ("A", D(2020, 1, 21)), ("A", D(2020, 2, 10)), ("A", D(2020, 4, 1))], "entity string, reaction_date date")
    assert sorted(r.reaction_date for r in ts.drop_close_repeats(ev_).collect()) == [D(2020, 1, 1), D(2020, 4, 1)]


def test_total_loss_stays_at_zero(spark):
    d = frame(spark, [(D(2020, 1, i + 1), r) for i, r in enumerate([0.1, -1.0, 0.5])], "date date, ret double")
    got = [(round(r.equity, 9), r.drawdown) for r in ts.cumulative_growth(d).orderBy("date").collect()]
    assert got == [(1.1, 0.0), (0.0, -1.0), (0.0, -1.0)]
    m = portfolio.metrics(d).first()
    assert m["cagr"] is None and m["total_return"] == -1.0


def test_turnover_matches_weights(spark):
    rows = [(D(2020, 3, 31), e, 1, 0.1) for e in "abcd"] + [(D(2020, 6, 30), e, 1, 0.2) for e in "bc"] + [(D(2020, 9, 30), e, 1, 0.0) for e in "bx"] + [(D(2020, 12, 31), "b", 1, 0.3)]
    d = frame(spark, rows, "date date, entity string, decile int, fwd_ret_1q double")
    got = {r.date: (r.turnover, r.n) for r in portfolio.hold_all(d, "decile").collect()}
    assert D(2020, 12, 31) not in got  # the last date is never held
    assert got[D(2020, 3, 31)] == (0.5, 4)
    assert got[D(2020, 6, 30)] == (0.5, 2)
    assert got[D(2020, 9, 30)] == (0.5, 2)


def test_first_filed_and_year_to_date(spark):
    rows = [
        ("A", "T", D(2020, 1, 1), D(2020, 3, 31), 10.0, D(2020, 5, 1), 2020), ("A", "T", D(2020, 1, 1), D(2020, 3, 31), 11.0, D(2021, 5, 1), 2020),
        ("A", "T", D(2020, 1, 1), D(2020, 6, 30), 25.0, D(2020, 8, 1), 2020), ("A", "T", D(2020, 1, 1), D(2020, 12, 31), 70.0, D(2021, 2, 1), 2020),
        ("A", "T", D(2020, 10, 1), D(2020, 12, 31), 21.0, D(2021, 2, 5), 2020), ("A", "T", D(2020, 1, 1), D(2020, 1, 31), 3.0, D(2020, 2, 1), 2020),
    ]
    f = frame(spark, rows, "entity string, tag string, start date, end date, val double, filed date, fy int")
    got = {r.end: (r.val, r.filed) for r in fu.quarterly_flow(f).collect()}
    assert got == {D(2020, 3, 31): (10.0, D(2020, 5, 1)), D(2020, 6, 30): (15.0, D(2020, 8, 1)), D(2020, 12, 31): (21.0, D(2021, 2, 5))}


def test_vendor_debt_is_missing_when_both_parts_are_zero(spark):
    rows = [("A", D(2020, 3 * q, 28), n, v) for q in (1, 2, 3, 4) for n, v in (("Total Revenue", 10.0), ("Long Term Debt", 0.0))] + [("A", D(2020, 12, 28), "Current Debt", 4.0)]
    got = {r.quarter_end: r for r in fu.factors_from_statements(frame(spark, rows, "entity string, quarter_end date, name string, value double")).collect()}
    assert got[D(2020, 3, 28)]["total_debt"] is None and got[D(2020, 12, 28)]["total_debt"] == 4.0
    assert got[D(2020, 12, 28)]["revenue_ttm"] == 40.0 and got[D(2020, 9, 28)]["revenue_ttm"] is None


def test_reconciliation_verdicts(spark):
    days = weekdays(3)
    old = frame(spark, [(e, d, 10.0) for e in "abcd" for d in days], "entity string, date date, close double")
    mult = {"a": [1, 1, 1], "b": [0.5, 0.5, 0.5], "c": [0.5, 0.9, 2.0], "d": [1.001, 1.0, 0.999]}
    new = frame(spark, [(e, d, 10.0 * m) for e, ms in mult.items() for d, m in zip(days, ms)], "entity string, date date, close double")
    got = {r.entity: r.verdict for r in reconcile.adjustment_verdicts(old, new).collect()}
    assert got == {"a": "keep", "b": "rescale", "c": "refetch", "d": "keep"}
    assert reconcile.degraded(new.where("entity = 'a'"), old).first()["degraded"]
    with pytest.raises(ValueError):
        reconcile.require_fresh(old, D(2021, 2, 1))


@pytest.fixture(scope="module")
def planted(spark):
    """24 quarters x 6 sectors x 40 names; four factors carry the signal, one is noise."""
    u = lambda k: F.randn(k)
    base = spark.range(24 * 240).select(
        F.last_day(F.add_months(F.lit("2018-03-31").cast("date"), (F.floor(F.col("id") / 240) * 3).cast("int"))).alias("date"),
        (F.col("id") % 240).alias("entity"), F.concat(F.lit("s"), (F.col("id") % 6).cast("string")).alias("sector"), F.lit("CORE").alias("index_name"),
        F.floor(F.col("id") / 240).cast("int").alias("period_no"), *[u(10 + i).alias(f"x{i}") for i in range(5)], u(99).alias("__e"),
    )
    expo = (F.col("x0") + F.col("x1") - F.col("x2") + F.col("x3")) / 4
    d = base.withColumn("fwd_ret_1q", -0.04 * expo + 0.06 * F.col("__e") + F.sin(F.col("period_no")) * 0.05).drop("__e").repartition(4).persist()
    d = peers.relative_to_median(d, {"fwd_ret_1q": "fwd_rel_ret_1q"}, large=False)
    z = peers.neutralize(d, {"x0": 1, "x1": 1, "x2": -1, "x3": 1, "x4": 1}, large=False)
    s = scoring.balanced_score(z, {"A": ["x0", "x1"], "B": ["x2", "x3"], "C": ["x4"]}, large=False).persist()
    s.count()
    return s


def test_planted_signal_is_found_and_permuting_kills_it(spark, planted):
    r = ev.ic_summary(planted, {"s": "score_ew"}, {"1q": "fwd_rel_ret_1q"}, {"1q": 3}, "Q", large=False).first()
    assert r["mean_ic"] > 0.1 and r["t_stat"] > 3 and r["n_periods"] == 24
    assert ev.monotonicity(ev.decile_table(planted, "decile_ew", "fwd_rel_ret_1q", large=False)).first()["rho"] < -0.7
    spread = ev.decile_spread(planted, "decile_ew", "fwd_rel_ret_1q").agg(F.avg("spread")).first()[0]
    assert spread > 0
    p = resampling.placebo(planted, "score_ew", "fwd_rel_ret_1q", 5, large=False).first()
    assert p["passed"] and abs(p["placebo_ic_mean"]) < 0.03


def test_decile_sizes_differ_by_at_most_one(planted):
    sizes = planted.groupBy("date", "sector", "decile_ew").count().groupBy("date", "sector").agg((F.max("count") - F.min("count")).alias("d"))
    assert sizes.agg(F.max("d")).first()[0] <= 1


def test_ridge_equals_the_direct_solution(planted):
    feats = [f"x{i}__n" for i in range(5)]
    scored, hist = learning.walk_forward(planted, feats, "fwd_rel_ret_1q")
    pdf = planted.select("date", "entity", *feats, "fwd_rel_ret_1q").toPandas().sort_values(["date", "entity"])
    days = sorted(pdf["date"].unique())
    t = days[10]
    tr = pdf[pdf["date"] < t]
    x, y = tr[feats].fillna(0).to_numpy(), tr["fwd_rel_ret_1q"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 10 * np.eye(5), xc.T @ yc)
    got = {r.feature: r.coef for r in hist.where(F.col("date") == F.lit(t)).collect()}
    assert [got[f"x{i}"] for i in range(5)] == pytest.approx(list(w), abs=1e-9)
    te = pdf[pdf["date"] == t]
    pred = -(y.mean() - x.mean(0) @ w + te[feats].fillna(0).to_numpy() @ w)
    out = scored.where(F.col("date") == F.lit(t)).orderBy("entity").select("score_ml").toPandas()["score_ml"]
    assert out.to_numpy() == pytest.approx(pred, abs=1e-9)
    assert scored.where(F.col("date") < F.lit(days[6])).where(F.col("score_ml").isNotNull()).count() == 0
    late = learning.training_moments(learning.date_moments(planted, feats, "fwd_rel_ret_1q"), feats, 6)
    n = {r.date: r.n for r in late.select("date", "n").collect()}
    assert n[days[0]] == 0 and n[days[2]] == 0 and n[days[3]] == 480  # 30 September less six months is 30 March


def test_variants_run(planted):
    feats = ["x0__n", "x2__n"]
    day = planted.agg(F.max("date")).first()[0]
    for kind in ("logistic", "gbm"):
        out = learning.walk_forward_variant(planted, feats, "fwd_rel_ret_1q", kind, [day], trees=3)
        r = ev.ic_series(out, {"s": "score_ml"}, {"1q": "fwd_rel_ret_1q"}, large=False).first()
        assert r["ic"] > 0


def test_random_sleeves_draw_without_replacement(spark, planted):
    pools = resampling.tier_pools(planted, "decile_ew")
    a = resampling.random_sleeves(pools, 6, 20).persist()
    assert a.groupBy("tier", "trial").count().agg(F.min("count"), F.max("count")).first()[:] == (24, 24)
    again = resampling.random_sleeves(pools, 6, 20)
    assert a.join(again.withColumnRenamed("ret", "r2"), ["tier", "trial", "date"]).where(F.abs(F.col("ret") - F.col("r2")) > 1e-12).count() == 0
    # brute force for one draw
    one = pools.where("tier = 'full'").select("date", "entity", "ret", F.xxhash64(F.lit(42), "tier", "date", F.lit(3), "entity").alias("u")).toPandas()
    want = one.sort_values(["date", "u", "entity"]).groupby("date").head(20).groupby("date")["ret"].mean()
    got = a.where("tier = 'full' and trial = 3").toPandas().set_index("date")["ret"].sort_index()
    assert got.to_numpy() == pytest.approx(want.to_numpy(), abs=1e-12)
    assert resampling.sleeve_distribution(resampling.sleeve_paths(a)).count() == 4


def test_random_composites_match_brute_force(spark, planted):
    feats = [f"x{i}__n" for i in range(5)]
    masks = resampling.factor_masks(spark, feats, 4)
    got = {r.draw: r.mean_ic for r in resampling.random_composites(planted, feats, "fwd_rel_ret_1q", masks, large=False).collect()}
    pdf = planted.select("date", *feats, "fwd_rel_ret_1q").toPandas()
    for m in masks.collect():
        assert len(set(m.picks)) == len(m.picks) >= 3
        pdf["z"] = pdf[[feats[i] for i in m.picks]].mean(axis=1).round(9)
        ic = [-g["z"].rank().corr(g["fwd_rel_ret_1q"].round(9).rank()) for _, g in pdf.groupby("date")]
        assert got[m.draw] == pytest.approx(np.mean(ic), abs=1e-9)


def test_variants_keep_every_row(spark, planted):
    feats = ["x0__n", "x2__n"]
    day = planted.agg(F.max("date")).first()[0]
    one_class = planted.withColumn("fwd_rel_ret_1q", F.when(F.col("fwd_rel_ret_1q").isNotNull(), 1.0))
    out = learning.walk_forward_variant(one_class, feats, "fwd_rel_ret_1q", "logistic", [day])
    assert out.count() == planted.count() and out.where(F.col("score_ml").isNotNull()).count() == 0
    out = learning.walk_forward_variant(planted, feats, "fwd_rel_ret_1q", "logistic", [day])
    assert out.count() == planted.count() and out.where((F.col("date") != F.lit(day)) & F.col("score_ml").isNotNull()).count() == 0


def test_tags_count_by_taxonomy(spark):
    schema = "entity string, taxonomy string, tag string, start date, end date, val double, filed date, fy int"
    D = dt.date
    rows = []
    for tax, scale, filed in (("ifrs-full", 7.0, D(2020, 4, 1)), ("us-gaap", 1.0, D(2020, 5, 1))):
        for q, (a, b) in enumerate([(D(2019, 4, 1), D(2019, 6, 30)), (D(2019, 7, 1), D(2019, 9, 30)), (D(2019, 10, 1), D(2019, 12, 31)), (D(2020, 1, 1), D(2020, 3, 31))]):
            rows += [("a", tax, "Revenues", a, b, 100.0 * scale, filed, 2020), ("a", tax, "NetIncomeLoss", a, b, 10.0 * scale, filed, 2020)]
            rows += [("a", tax, "Assets", None, b, 1000.0 * scale, filed, 2020)]
    facts = spark.createDataFrame(rows, schema)
    with_all = fu.fundamentals(facts).collect()
    only = fu.fundamentals(facts.where("taxonomy = 'us-gaap'").drop("taxonomy")).collect()
    assert with_all and sorted(map(str, with_all)) == sorted(map(str, only))


def test_truncation_check_finds_a_look_ahead(spark):
    D = dt.date
    bars = spark.createDataFrame([(e, D(2020, 1, d), float(d * k), d) for k, e in enumerate("ab", 1) for d in range(1, 21)], "entity string, date date, close double, session_no int")
    w = Window.partitionBy("entity").orderBy("date")
    honest = lambda b: b.withColumn("past", F.lag("close", 3).over(w)).withColumn("ahead", F.lead("close", 1).over(w))
    sees = lambda b: honest(b).withColumn("ahead", F.max("close").over(Window.partitionBy("entity")))
    got = {(r.date.day, r.feature): (r.checked, r.mismatches) for r in checks.truncation_invariance(bars, honest, ["past", "ahead"], ["2020-01-02", "2020-01-10"]).collect()}
    assert got == {(2, "past"): (0, 0), (2, "ahead"): (0, 0), (10, "past"): (2, 0), (10, "ahead"): (0, 0)}
    got = {(r.date.day, r.feature): (r.checked, r.mismatches) for r in checks.truncation_invariance(bars, sees, ["past", "ahead"], ["2020-01-10"]).collect()}
    assert got == {(10, "past"): (2, 0), (10, "ahead"): (2, 2)}


def plain_logistic(x, t, penalty=1.0):
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - t) + ridge @ w)
    return w


def test_logistic_fits_of_all_dates_match_a_plain_solver(spark):
    rng = np.random.default_rng(4)
    days = [dt.date(2020, 1, 1) + dt.timedelta(91 * i) for i in range(10)]
    rows = []
    for i in range(900):
        x = rng.normal(0, 1, 3)
        y = None if i % 17 == 0 else float(np.round(-x[0] + 0.5 * x[1] + rng.normal(0, 1), 1))
        rows.append((days[i % 10], i, *[None if i % 13 == 0 else float(v) for v in x], y, "IN" if i % 4 else "OUT"))
    df = spark.createDataFrame(rows, "date date, entity long, a double, b double, c double, y double, side string")
    got = learning.walk_forward_logistic(df, ["a", "b", "c"], "y", F.col("side") == "IN", min_prior=3, min_rows=60)
    scores = {r.entity: r.score_ml for r in got.collect()}
    assert len(scores) == 900
    for day in days:
        train = [r for r in rows if r[0] < day and r[5] is not None and r[6] == "IN"]
        test = [r for r in rows if r[0] == day]
        if day < days[3] or len(train) < 60:
            assert all(scores[r[1]] is None for r in test)
            continue
        y = np.array([r[5] for r in train])
        w = plain_logistic(np.array([[v or 0.0 for v in r[2:5]] for r in train]), (y <= np.quantile(y, 0.25)).astype(float))
        for r in test:
            assert abs(scores[r[1]] - 1 / (1 + np.exp(-(w[0] + w[1:] @ np.array([v or 0.0 for v in r[2:5]]))))) < 1e-7


@pytest.mark.parametrize("prob", [0.0, 0.25, 0.5, 1.0])
def test_growing_quantiles(spark, prob):
    rng = np.random.default_rng(5)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(6)]
    rows = [(days[i % 6], 1.5 if i % 3 == 0 else float(np.round(rng.normal(), 2))) for i in range(700)]
    df = spark.createDataFrame(rows, "date date, v double")
    fits = spark.createDataFrame([(d,) for d in days], "date date")
    got = {r.fit: (r.n, r.cut) for r in learning.growing_quantile(df, fits, "v", prob, 16).collect()}
    for d in days[1:]:
        past = [x for day, x in rows if day < d]
        assert got[d][0] == len(past) and abs(got[d][1] - np.quantile(past, prob)) < 1e-12


def test_features_at_points_are_those_of_the_dense_grid(spark):
    rng = np.random.default_rng(6)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(120)]
    rows = []
    for e, share in (("full", 1.0), ("thin", 0.5), ("rare", 0.12), ("late", 0.8), ("stops", 0.9), ("once", 0.0)):
        price = 50.0
        for i, d in enumerate(days):
            price *= 1 + rng.normal(0, 0.02)
            lives = (e != "late" or i > 50) and (e != "stops" or i < 60) and (rng.random() < share or (e == "once" and i == 30))
            if lives:
                rows.append((e, d, float(price), float(rng.integers(0, 4) * 100)))
    bars_ = spark.createDataFrame(rows, "entity string, date date, close double, volume double")
    cal = calendar.session_calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    stamped = calendar.with_sessions(bars_, cal)
    mkt = ts.market_returns(spark.createDataFrame([(d, float(100 + np.sin(i) * 5 + i / 7)) for i, d in enumerate(days)], "date date, close double"), cal)
    dense = ts.price_features(ts.session_returns(ts.dense_grid(stamped, cal)), mkt, 4, 12, 40)
    names = [c for c in dense.columns if c not in ("entity", "date", "session_no")]
    for c in names:
        dense = ts.carry_forward(dense, c, c)
    every = dense.select("entity", "session_no")
    for points in (every, every.where(F.col("session_no") % 10 == 7)):
        got = {(r.entity, r.session_no): r for r in ts.price_features_at(stamped, points, mkt, 4, 12, 40).collect()}
        assert len(got) == points.count()
        filled = dict.fromkeys(names, 0)
        for r in dense.collect():
            if (r.entity, r.session_no) in got:
                for c in names:
                    a, b = r[c], got[r.entity, r.session_no][c]
                    filled[c] += a is not None
                    assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9 + 1e-7 * abs(a)), (c, r, b)
        assert all(n > 3 for n in filled.values()), filled


def test_permuted_scores_carry_labels_and_move_once(spark):
    import hashlib

    rows = [(dt.date(2024, 1, 1 + i % 2), i, float(i) if i % 7 else None, float(100 + i)) for i in range(40)] + [(dt.date(2024, 1, 1), 4, 4.5, 204.0), (dt.date(2024, 1, 1), None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "date date, entity long, v double, y double")
    got = resampling.permuted_scores(df, "v", 3, 5, large=False, carry=["y"])
    seen = [tuple(r) for r in got.select("trial", "date", "entity", "y", "score").collect()]
    assert len(seen) == 3 * len(rows) and {r[2:4] for r in seen} == {(e, y) for _, e, _, y in rows}
    for trial in range(3):
        day = [r for r in rows if r[0] == dt.date(2024, 1, 2)]
        dealt = sorted(day, key=lambda r: (hashlib.md5(f"5|{trial}|{r[0]}|{r[1]}".encode()).hexdigest(), r[1]))
        want = [(trial, a[0], a[1], a[3], b[2]) for a, b in zip(sorted(day, key=lambda r: r[1]), dealt)]
        assert sorted(r for r in seen if r[0] == trial and r[1] == dt.date(2024, 1, 2)) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # by date, then by trial and date


def test_composites_of_a_date_are_ranked_where_its_rows_lie(spark, monkeypatch):
    """Ties, nulls, NaN, a null date and a thin one: as the shuffled ranks, with one exchange of the rows whatever the number of draws."""
    from peerlens.operators import ranking

    rng = np.random.default_rng(11)
    rows = []
    for k, n in ((None, 40), (1, 60), (2, 33), (3, 4)):
        for i in range(n):
            x = [None if rng.random() < 0.4 else float(rng.integers(0, 4)) / 3 for _ in range(4)]
            x[0] = float("nan") if rng.random() < 0.05 else x[0]
            y = None if rng.random() < 0.1 else float(rng.integers(0, 9))
            rows.append((k and dt.date(2024, k, 1), i, y, *x))
    df = spark.createDataFrame(rows, "date date, entity long, y double, a double, b double, c double, d double")
    masks = spark.createDataFrame([(0, [0, 1]), (5, [3]), (7, [2, 1, 3, 0])], "draw int, picks array<int>")
    near = resampling.random_composites(df, list("abcd"), "y", masks, large=False)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning(date") + plan.count("REPARTITION_BY_NUM") <= 2
    assert near.schema["draw"].dataType == masks.schema["draw"].dataType
    want = {r.draw: r.mean_ic for r in resampling.random_composites(df, list("abcd"), "y", masks, large=True).collect()}
    got = {r.draw: r.mean_ic for r in near.collect()}
    assert set(got) == set(want) == {0, 5, 7} and got == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(resampling, "HELD_ROWS", 40)  # two dates of each form
    monkeypatch.setattr(ranking, "TARGET_GROUP_ROWS", 10)
    assert {r.draw: r.mean_ic for r in resampling.random_composites(df, list("abcd"), "y", masks).collect()} == pytest.approx(want, abs=1e-12)


def _orders_of(tmp_path, spark, parts, lines):
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    kind = "l_shipdate timestamp, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(lines, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_peer_groups_are_bounded_by_the_parts_of_a_class(spark, tmp_path, monkeypatch):
    """More parts than fit a group, but no class with so many: nothing is written to look the groups up, rows go to tasks by their number."""
    from peerlens.operators import ranking
    from peerlens.plans import PLANS, views

    parts = [(i, f"T{i % 3}", 10 + 30 * (i % 2)) for i in range(60)]
    lines = [(dt.datetime(2024, 1 + 3 * q, 5), i, i % 4, 1.0 + i, 100.0 * (i + 1) + q, 0.01 * (i % 5), 0.02, "R" if i % 3 else "N") for i in range(60) for q in range(3)]
    sf = _orders_of(tmp_path, spark, parts, lines)
    names = ["peer_rank_variant", "winsorized_factors", "small_peer_groups_dropped", "average_rank_of_ties", "absolute_risk", "worst_ten_names"]
    want = {n: sorted(map(str, PLANS[n](spark, sf).collect())) for n in names}
    monkeypatch.setattr(ranking, "TARGET_GROUP_ROWS", 30)
    monkeypatch.setattr(views, "TASK_ROWS", 20)
    assert views.large(spark, sf) is None and views.large_peers(spark, sf) is False
    written = []
    monkeypatch.setattr(ranking, "durable", lambda df, keep=ranking.durable: written.append(df.columns) or keep(df))
    assert PLANS["small_peer_groups_dropped"](spark, sf).count() and not written
    wide = PLANS["peer_rank_variant"](spark, sf)
    assert not written and f"REPARTITION_BY_NUM" in wide._jdf.queryExecution().executedPlan().toString()
    for n in names:
        assert sorted(map(str, PLANS[n](spark, sf).collect())) == want[n], n


def test_dates_of_the_selection_are_bounded_by_its_parts(spark, tmp_path, monkeypatch):
    """More parts than fit a group, but fewer in the selected index: its correlations write nothing to look dates up."""
    from peerlens.operators import ranking
    from peerlens.plans import PLANS, views

    parts = [(i, f"T{i % 3}", 10 + 30 * (i % 2)) for i in range(60)]
    lines = [(dt.datetime(1999, 1 + 3 * q, 5), i, i % 4, 1.0 + i * 7 % 11, 100.0 * (i + 1) + i * q, 0.01 * (i % 5), 0.02, "R" if i % 3 else "N") for i in range(60) for q in range(3)]
    sf = _orders_of(tmp_path, spark, parts, lines)
    names = ["ic_by_year", "stress_window_table"]
    want = {n: sorted(map(str, PLANS[n](spark, sf).collect())) for n in names}
    assert "n_periods=2" in want["ic_by_year"][0]
    monkeypatch.setattr(ranking, "TARGET_GROUP_ROWS", 30)
    assert views.large(spark, sf) is None and views.large_selected(spark, sf) is False and views.large_selected(spark, sf, 29) is None
    written = []
    monkeypatch.setattr(ranking, "durable", lambda df, keep=ranking.durable: written.append(df.columns) or keep(df))
    for n in names:
        assert sorted(map(str, PLANS[n](spark, sf).collect())) == want[n] and not written, n


def test_line_items_of_a_panel_move_once(spark, tmp_path, monkeypatch):
    """Line items reach their (date, part) in one shuffle, in as many tasks as there are items for, with the sums of a plain loop."""
    import datetime as dt
    import re

    from peerlens.plans import views

    items = [
        (i, None if i == 7 else i % 5, i % 3, float(1 + i % 4), 100.0 + i, (i % 10) / 100, 0.01, "RAN"[i % 3], None if i == 9 else dt.datetime(1996, 1 + i % 9, 3))
        for i in range(60)
    ]
    items += items[20:24]  # rows that come twice
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    sf = str(tmp_path)
    spark.createDataFrame(items, names).write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(p, "T", 1 + 20 * p) for p in range(5)], "p_partkey long, p_type string, p_size int").write.parquet(f"{sf}/part.parquet")
    want = {}
    for _, part, supp, qty, price, _, _, flag, day in items:
        if part is not None:
            date = day and dt.date(day.year, day.month - (day.month - 1) % 3, 1)
            g = want.setdefault((date, part), [0, set(), 0.0, 0.0, 0])
            g[0], g[2], g[3], g[4] = g[0] + 1, g[2] + qty, g[3] + price, g[4] + (flag == "R")
            g[1].add(supp)
    for tasks in (2, 16):  # fewer than the session's partitions, then more
        monkeypatch.setattr(views, "TASK_ROWS", 64 // tasks)
        d = views.shipments(spark, sf)
        got = {(r["date"], r["entity"]): r for r in d.collect()}
        assert got.keys() == want.keys()
        for k, (n, supps, qty, price, returned) in want.items():
            assert (got[k]["f_lines"], got[k]["f_supp"], got[k]["f_qty"]) == (n, len(supps), qty)
            assert (got[k]["px"], got[k]["f_ret"]) == (pytest.approx(price / qty + 50000), pytest.approx(returned / n))
        moves = re.findall(r"(?<!Broadcast)Exchange \w+partitioning\(.*", views.shipments(spark, sf)._jdf.queryExecution().executedPlan().toString())
        assert len(moves) == 1, moves
        if tasks == 16:
            assert views.shipments(spark, sf).rdd.getNumPartitions() == 16


def test_last_events_do_not_move_rows_to_peer_groups(spark, tmp_path, monkeypatch):
    """Nothing of a peer group is read, so no row is moved by sector however many line items there are."""
    from peerlens.plans import PLANS, views

    parts = [(i, f"T{i % 3}", 10 + 30 * (i % 2)) for i in range(60)]
    lines = [(dt.datetime(2024, 1 + 3 * q, 5), i, i % 4, 1.0 + i, 100.0 * (i + 1) + q, 0.01 * (i % 5), 0.02, "R" if i % 3 else "N") for i in range(60) for q in range(3) if i % 4 or q < 2]
    sf = _orders_of(tmp_path, spark, parts, lines)
    monkeypatch.setattr(views, "TASK_ROWS", 20)
    d = PLANS["last_event_of_names"](spark, sf)
    assert sorted(map(tuple, d.collect())) == [(i, dt.date(2024, 7, 1), dt.date(2024, 4, 5)) for i in range(60) if i % 4]
    moves = [x for x in d._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert moves and not any("sector" in x for x in moves)
