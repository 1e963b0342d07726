"""Times the headline queries on one node and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlark.plans import catalog  # noqa: E402
from fleetlark.session import local_session  # noqa: E402

HEADLINE = [
    "a2_route_events", "a4_dlq_report", "b1_latest_reading", "b4_readings_between_all", "b6_silent_vehicles",
    "c1_covers_join", "c1_covers_depots", "c2_within_distance", "c6_assign_zone", "c8_leg_distance",
    "d1_speeding", "d2_idle", "d3_geofence", "d3_geofence_buffer", "d4_all_alerts", "d10_build_status", "d12_enrich",
    "e3_top_offenders", "e6_summary", "e7_fleet_stats", "e10_stats_5m", "e10_stats_1d", "e11_running", "f2_delete_ids",
]


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds to build the plan and to compute every row and column of the result."""
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "fleetlark-bench")
    # The first queries pay for starting the JVM's compilers, whichever they are.
    for name in ("e1_by_type", "c6_assign_zone", "d2_idle"):
        run(spark, name, sf_dir)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
