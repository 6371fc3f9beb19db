"""Cutting large groups into slices must not change a single result."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peerlens.operators import evaluation, peers, ranking, resampling


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds a third of the rows, a third of its values are one tie, some are missing."""
    d = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.col("id").alias("entity"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, F.lit(1.0)).when(F.pmod(F.xxhash64("id"), F.lit(11)) == 1, None)
        .otherwise(F.round(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5000)) / 100.0, 2)).alias("v"),
        F.round(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(977)) / 10.0, 2).alias("y"),
        F.lit("2020-03-31").cast("date").alias("date"),
    )
    return d.persist()


def same(a, b):
    key = lambda r: tuple((x is None, x) for x in r)
    near = lambda x: round(x, 9) if isinstance(x, float) else tuple(near(y) for y in x) if isinstance(x, list) else x
    rnd = lambda d: sorted((tuple(near(x) for x in r) for r in d.select(*sorted(d.columns)).collect()), key=key)
    x, y = rnd(a), rnd(b)
    assert x == y
    assert x


@pytest.fixture(autouse=True)
def small_target(monkeypatch):
    monkeypatch.setattr(ranking, "TARGET_GROUP_ROWS", 250)


def test_groups_are_really_cut(rows):
    cut = ranking.cut_into_slices(rows.where(F.col("v").isNotNull()), ["g"], ["v", "entity"])
    sizes = cut.where(F.col("g") == "hot").groupBy("__slice").count().collect()
    assert len(sizes) >= 3
    assert max(r["count"] for r in sizes) < 600
    # the pieces are ordered: no row of a later slice sorts before one of an earlier slice
    ends = cut.groupBy("g", "__slice").agg(F.min("__ord").alias("lo"), F.max("__ord").alias("hi"))
    w = Window.partitionBy("g").orderBy("__slice")
    assert ends.withColumn("prev", F.lag("hi").over(w)).where(F.col("prev") >= F.col("lo")).count() == 0


def all_forms(make):
    """As windows, as the forms for large groups, and split by size: one group is large, the others are not."""
    same(make(False), make(True))
    same(make(False), make(None))


def test_no_job_runs_while_a_plan_of_bounded_groups_is_built(spark, rows):
    rows.count()
    spark.sparkContext.setJobGroup("plan", "plan")
    z = peers.neutralize(rows, {"v": 1, "y": -1}, ["g"], large=False)
    peers.peer_decile(z, "v__n", "d", ["g"], large=False)
    evaluation.calibration_table(rows.withColumn("s", F.col("y")), "s", "v", large=False)
    ranking.group_quantiles(rows, ["g"], ["v"], [0.5], False)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("plan")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_row_numbers(rows):
    d = rows.where(F.col("v").isNotNull())
    all_forms(lambda large: ranking.numbered(d, ["g"], ["v", "entity"], large=large))


def test_average_ranks(rows):
    all_forms(lambda large: ranking.average_rank(rows, ["g"], "v", "r", ["entity"], large))


@pytest.mark.parametrize("probs", [[0.02, 0.5, 0.98], [0.0, 1.0], [0.25]])
def test_quantiles(rows, probs):
    all_forms(lambda large: ranking.group_quantiles(rows, ["g"], ["v", "y"], probs, large))
    all_forms(lambda large: ranking.group_quantiles(rows, [], ["v", "y"], probs, large))


def test_quantiles_of_many_rows_in_brackets(spark):
    d = spark.range(200_000).select((F.col("id") % 2).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(10_007)) / 7.0).alias("v"))
    same(ranking.group_quantiles(d, ["g"], ["v"], [0.01, 0.5, 0.99], False), ranking.group_quantiles(d, ["g"], ["v"], [0.01, 0.5, 0.99], True))


def test_neutralized_factors_and_deciles(rows):
    f = {"v": 1, "y": -1}
    all_forms(lambda large: peers.neutralize(rows, f, ["g"], large=large))
    a = peers.neutralize(rows, f, ["g"], large=False)
    all_forms(lambda large: peers.peer_decile(a, "v__n", "d", ["g"], large=large))


def test_rank_method_medians_and_risk(rows):
    all_forms(lambda large: peers.neutralize(rows, {"v": 1}, ["g"], method="rank", large=large))
    all_forms(lambda large: peers.relative_to_median(rows, {"v": "m"}, ["g"], large=large))
    all_forms(lambda large: peers.absolute_risk(rows, {"v": 1, "y": 1}, "g", large=large))


def test_rank_correlation_and_label_clipping(rows):
    p = rows.where(F.col("v").isNotNull()).select("g", "entity", F.col("v").alias("s"), "y")
    all_forms(lambda large: evaluation.rank_correlation(p, ["g"], large=large))
    all_forms(lambda large: evaluation.clip_labels(rows, "y", "w", ["g"], large=large))
    all_forms(lambda large: evaluation.clip_labels(rows, "y", "w", [], large=large))


def test_ranks_shared_by_pairs_are_the_ranks_of_each_pair(rows):
    d = rows.select(F.col("g").alias("date"), "entity", "v", "y", F.when(F.col("entity") % 5 > 0, F.col("y") * -1).alias("u"))
    all_forms(lambda large: evaluation.ic_series(d, {"a": "v", "b": "u"}, {"1": "y", "2": "u"}, large=large))


def test_permutation_keeps_the_values(rows):
    for large in (False, True, None):
        p = resampling.permuted_scores(rows, "v", 2, large=large)
        want = sorted((x.v is None, x.v) for x in rows.select("v").collect())
        got = p.where(F.col("trial") == 1).select("score").collect()
        assert sorted((x.score is None, x.score) for x in got) == want
        moved = p.where(F.col("trial") == 0).join(rows, "entity").where(~F.col("score").eqNullSafe(F.col("v"))).count()
        assert moved > 1000


def test_large_groups_are_written_once(spark, rows):
    """Bins of large dates: one table holds the rows, the others a row per group or slice, and numbering moves rows once."""
    from peerlens import session

    d = rows.where(F.col("v").isNotNull()).select("g", "entity", "v", F.col("y").alias("more"))
    before = len(session._WRITTEN)
    got = peers.calibration_bins(d.select("g", "entity", "v"), "v", by=["g"], large=None)
    assert "__s" not in got.columns and got.count() == d.count()
    sizes = sorted(spark.read.parquet(p).count() for p in session._WRITTEN[before:])
    assert sizes[-1] == d.count() and sum(sizes[:-1]) < 100
    plan = peers.calibration_bins(session.durable(d), "v", by=["g"], large=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    same(peers.calibration_bins(d, "v", by=["g"], large=False), got.join(d, ["g", "entity", "v"]))


def test_a_turn_of_a_loop_leaves_one_table(spark, rows):
    import os

    from peerlens import session

    before = len(session._WRITTEN)
    got = session.alone(spark, lambda: ranking.numbered(rows, ["g"], ["entity"]).groupBy("g").count())
    assert len(session._WRITTEN) == before + 1 and got.count() == 8
    folder = os.path.dirname(session._WRITTEN[-1])
    assert {p for p in os.listdir(folder)} >= {os.path.basename(session._WRITTEN[-1])}
    assert sum(os.path.join(folder, p) not in session._WRITTEN for p in os.listdir(folder) if p.startswith("stage-")) == 0


def test_pairs_of_series_move_rows_once(spark, rows):
    """Nulls, NaN and ties in every column: the columns of a date move together, and pairs of large dates leave only their figures."""
    from peerlens import session

    d = rows.select(
        F.col("g").alias("date"), "entity", "v", F.when(F.col("entity") % 9 == 0, float("nan")).otherwise(F.col("y")).alias("y"),
        F.when(F.col("entity") % 5 > 0, F.col("y") * -1).alias("u"), F.lit(1.0).alias("one"), F.lit(None).cast("double").alias("none"),
    ).unionByName(rows.limit(30).select(F.lit(None).cast("string").alias("date"), "entity", "v", "y", *[F.lit(0.5).alias(c) for c in ("u", "one", "none")]))
    d = session.durable(d)
    make = lambda large: evaluation.ic_series(d, {"a": "v", "b": "u", "c": "one", "e": "none"}, {"1": "y", "2": "u"}, large=large)
    plan = make(False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan and "Window" not in plan
    want = []
    for i, s in (("a", "v"), ("b", "u"), ("c", "one")):
        for j, y in (("1", "y"), ("2", "u")):
            p = d.where(F.col(s).isNotNull() & F.col(y).isNotNull()).select("date", "entity", F.col(s).alias("s"), F.col(y).alias("y"))
            r = evaluation.rank_correlation(p, ["date"], large=False).where("n >= 10 AND rho IS NOT NULL")
            want.append(r.select(F.lit(i).alias("series"), F.lit(j).alias("horizon"), "date", (-F.col("rho")).alias("ic"), "n"))
    want = want[0].union(want[1]).union(want[2]).union(want[3]).union(want[4]).union(want[5])
    same(make(False), want)
    before = len(session._WRITTEN)
    same(make(True), want)
    assert sum(spark.read.parquet(p).count() for p in session._WRITTEN[before:]) < 100


def test_trials_are_dealt_where_rows_lie(spark, rows, monkeypatch):
    """Repeated, missing and tied rows: as the permutation that moves a row per trial, without such a move; large dates turn by turn."""
    from peerlens import session

    d = rows.where("g <> 'g0'").select(F.col("g").alias("date"), "entity", "v", F.when(F.col("entity") % 8 > 0, F.col("y")).alias("y"))
    d = d.unionByName(d.where("entity % 10 = 1").withColumn("y", F.col("y") + 1)).unionByName(d.where("entity % 50 = 2").select("date", F.lit(None).cast("long").alias("entity"), F.lit(2.0).alias("v"), "y"))
    d = session.durable(d.unionByName(d.limit(20).withColumn("date", F.lit(None).cast("string"))))
    plan = resampling.placebo(d, "v", "y", 3, large=False)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    told = d.select("date", "entity", "v", F.collect_list("y").over(Window.partitionBy("date", "entity")).alias("__y"))
    pairs = resampling.permuted_scores(told, "v", 3, 0, False, ["__y"]).where("score IS NOT NULL AND entity IS NOT NULL")
    pairs = pairs.select("trial", "date", "entity", F.round("score", 9).alias("s"), F.explode("__y").alias("y"))
    per = evaluation.rank_correlation(pairs, ["trial", "date"], large=False).where("n >= 10").groupBy("trial").agg(F.avg(-F.col("rho")).alias("m"))
    want = per.agg(F.avg("m").alias("placebo_ic_mean"), F.stddev_pop("m").alias("placebo_ic_std"))
    monkeypatch.setattr(resampling, "HELD_ROWS", 500)  # one date is larger
    before = len(session._WRITTEN)
    for large in (False, True, None):
        same(resampling.placebo(d, "v", "y", 3, large=large).select("placebo_ic_mean", "placebo_ic_std"), want)
    few = [n for n in (spark.read.parquet(p).count() for p in session._WRITTEN[before:]) if n < 100]
    assert len(few) >= 6 and len(session._WRITTEN) - before - len(few) <= 4
