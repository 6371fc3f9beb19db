"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from peerlens.plans import PLANS  # noqa: E402
from peerlens.session import build_session, release  # noqa: E402

HEADLINE = [
    "worst_ten_names",
    "peer_zscores",
    "peer_deciles",
    "absolute_risk",
    "horizon_term_structure",
    "score_calibration_table",
    "flag_event_study",
    "decile_transition_matrix",
    "evidence_weighted_score",
    "walk_forward_ridge_scores",
    "sleeves_by_year",
    "random_sleeve_distribution",
    "trailing_price_features",
    "gated_forward_returns",
    "asof_latest_fact",
    "members_by_date",
    "fundamental_factors",
    "insider_flow_by_issuer",
    "panel_assembled",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    run(PLANS["worst_ten_names"](spark, sf))  # start the JVM's compilers
    release(spark)
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.perf_counter()
        run(PLANS[name](spark, sf))
        times[name] = round(time.perf_counter() - t, 3)
        release(spark)  # no query reads what another one held
        print(name, times[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds over headline panel queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
