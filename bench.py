"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERIES = [
    "src1_scan_raw_observations",
    "dec_decode_metar",
    "agg1_daily_high",
    "joi1_label_rows",
    "win1_day_running",
    "win2_lookback_context",
    "joi3_hour_lags",
    "joi7_daily_comparison",
    "agg6_errors_by_station_hour",
    "joi15_win7_win8_station_ranking",
    "agg10_residual_calibration",
    "win4_win5_drift",
    "agg16_performance_by_event",
    "joi17_position_market",
    "joi9_unique_market",
    "joi10_adjacent_pair",
    "mkt4_joi13_interval_confidence",
    "mkt8_pair_plan",
    "win13_depth_price_notional",
    "joi22_best_buy_price",
    "win14_fillable_now",
    "win16_fill_increments",
    "win9_win10_trailing_flow",
    "win12_recent_mean",
    "mkt15_fair_value",
    "str5_momentum_triggers",
    "par12_message_prices",
    "flt6_log_filter",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]

    from skytally import session
    from skytally.plans import catalog

    spark = session.build(f"local[{cpus}]", "skytally-bench", shuffle_partitions=cpus)
    # One small query first, so that JVM start-up is not charged to the first headline query.
    catalog.QUERIES["agg15_status_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in QUERIES:
        if only and not any(o in name for o in only):
            continue
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
