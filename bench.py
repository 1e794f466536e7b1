"""Wall-clock of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    # preparation
    "d2_latest_review", "j4_star_join", "e1_analysis_table", "s5_numeric_profile",
    # features
    "m2_order_time_frame", "m3_after_delivery_frame",
    # reports
    "r4_delay_by_distance", "r5_top_categories_by_state", "r10_score_by_delivery_days",
    "r13_speed_groups", "r17_score_by_threshold_band", "r18_delay_rate_by_dispatch_speed",
    "r21_customer_state_statistics", "r25_state_category_shares",
    # statistics
    "w5_k1_midranks_of_prices", "k2_k3_dispatch_of_delayed_items", "k5_spearman_matrix",
    "k10_delay_threshold_test",
    # splits and metrics
    "g2_stratified_folds", "v3_w6_threshold_sweep", "v10_promise_tradeoff",
    # models, streams
    "m6_v9_order_time_hold_out", "m7_v10_quantile_tradeoff", "st2_alerts_once",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from parcelsight.plans.catalog import queries
    from parcelsight.session import local_session

    spark = local_session("bench")
    registered = queries()
    run = lambda name: registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("r18_delay_rate_by_dispatch_speed")  # start-up cost of the session, not measured
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall-clock", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
