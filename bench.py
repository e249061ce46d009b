"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codestrata.plans.catalog import QUERIES
from codestrata.session import local_session

HEADLINE = (
    "p1_commit_history", "a2_change_metrics", "a7_hotspots", "a10_commit_statistics", "a12_complexity_trends",
    "a13_timeline", "i4_subsystem_health", "i6_refactor_alerts", "i8_risk_areas", "i15_codebase_metrics",
    "i18_resource_forecast", "i20_dashboard", "m3_engineer_features", "m6_label_hotspots", "r2_duplicate_blocks",
    "r6_file_complexity", "r12_high_coupling", "g3_module_connections", "g8_modularity", "t8_commit_story",
    "e2_l2_norm", "e4_most_similar", "st2_daily_velocity", "g7_strongly_connected_imports", "r11_circular_imports",
    "r13_refactor_analysis", "g14_code_map_metadata",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
