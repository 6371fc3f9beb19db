"""Registered queries against their SQL on the smallest tables.

PEERLENS_ALL=1 checks every query; the default is one or two per operator family."""

import os

import pytest
from compare import compare, duck

from peerlens.plans import PLANS, SQL

SF = os.environ.get("PEERLENS_SF", "/root/testdata/sf0.001")
SAMPLE = [
    "family_balanced_score", "peer_deciles", "factor_decomposition", "horizon_term_structure", "score_calibration_table", "flag_event_study",
    "evidence_weighted_score", "walk_forward_one_factor", "sleeves_by_year", "trailing_price_features", "event_reaction_with_expiry",
    "gated_forward_returns", "asof_latest_fact", "members_by_date", "fundamental_factors", "membership_csv_repaired", "override_log_validated",
    "filing_documents_flattened", "earnings_reaction_days", "streamed_daily_flow", "orders_written_by_year", "membership_snapshot_appended",
    "records_written_as_lines", "streamed_bars_topped_up", "truncation_invariance", "in_sample_ceiling", "random_sleeve_distribution", "model_comparison", "promotion_with_hysteresis",
    "panel_assembled_with_statements", "panel_with_every_feed", "logistic_variant_coverage",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("PEERLENS_ALL") else SAMPLE)
def test_matches_sql(spark, con, name):
    result = compare(PLANS[name](spark, SF), con, SQL[name])
    assert result.startswith("ok"), result


def test_every_query_has_a_name_of_its_own():
    assert set(SQL) <= set(PLANS)
    assert len(PLANS) > 150


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["date", "entity", "sector", "score_ew", "decile_ew", "sell_rank"]
    assert df.count() == 10


@pytest.mark.parametrize("name", ["peer_deciles", "rank_ic_by_date"])
def test_same_answers_when_every_group_is_too_large_for_one_task(spark, con, name, monkeypatch):
    from peerlens.operators import ranking

    monkeypatch.setattr(ranking, "TARGET_GROUP_ROWS", 40)
    result = compare(PLANS[name](spark, SF), con, SQL[name])
    assert result.startswith("ok"), result


def test_learned_score_needs_only_the_selected_rows(spark, tmp_path):
    """Rows of other indexes count as dates before a fit and nothing else; no panel row is held, and a month of others alone still counts."""
    from pyspark.sql import functions as F

    from peerlens import session
    from peerlens.operators import learning
    from peerlens.plans import catalog_grading as g, views as v

    for t in ("part", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    others = spark.range(40).select((F.col("id") + 900_000).alias("id"))  # thirty names of an early month, none of them selected
    part, line = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("part", "lineitem"))
    one = part.limit(1).crossJoin(others).withColumn("p_partkey", F.col("id")).withColumn("p_size", F.lit(40).cast(part.schema["p_size"].dataType))
    one.select(part.columns).write.mode("append").parquet(f"{tmp_path}/part.parquet")
    item = line.limit(1).crossJoin(others).withColumn("l_partkey", F.col("id")).withColumn("l_shipdate", F.lit("1980-02-03").cast(line.schema["l_shipdate"].dataType))
    item.select(line.columns).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    held = len(session._HELD)
    got = g.learned(spark, str(tmp_path), "entity", "score_ew")
    assert [d.columns for d in session._HELD[held:]] == [["date", "intercept", "coef"]]
    whole = learning.walk_forward(v.crossed(spark, str(tmp_path), "month"), g.ML, "fwd_rel_ret_1q", F.col("index_name") == v.SELECTION)[0]
    want = whole.where(F.col("index_name") == v.SELECTION)
    rows = lambda d: sorted(d.select("date", "entity", *[F.round(c, 9) for c in ("score_ew", "score_ml", "fwd_rel_ret_1q")]).collect(), key=lambda r: r[:2])
    a, b = rows(got), rows(want)
    assert a == b and any(r[3] is not None for r in a)
    assert v.crossed(spark, str(tmp_path), "month").agg(F.min("date")).first()[0].year == 1980
