"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegrid.registry import all_queries  # noqa: E402
from tidegrid.session import local_session  # noqa: E402

HEADLINE = [
    "effort_daily", "effort_monthly", "permit_interval_join", "quantiles_wide", "running_percent_of_total",
    "areal_weighted_overlay", "points_in_polygons", "mean_of_four_nearest", "inverse_distance_grid",
    "distance_to_closed_cells", "pots_from_logs", "trap_density_two_ways", "temporal_redistribution",
    "scenario_risk_by_region", "scenario_tradeoff", "event_lookback_risk", "displaced_effort_risk",
    "covariate_table", "vessel_movement_matrix", "rank_sum_test",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "tidegrid-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in HEADLINE:
        seen = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seen), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
