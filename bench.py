"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built and run to a no-op sink: once to warm up, then three times;
the median counts.  Building is part of the time, as some plans fix their
range partitions while they are built.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlens.plans import load_all  # noqa: E402
from fleetlens.session import session  # noqa: E402

HEADLINE = (
    # scans, filters, decodes
    "snapshot_scan", "security_changes", "disk_latency", "command_log_report", "backup_eligibility",
    # joins
    "indexes_unused", "index_last_usage", "missing_index_advice", "head_blockers", "invalid_objects",
    # aggregations, pivots, string lists
    "resource_summary", "last_backup_by_type", "buffer_pool_by_index", "table_size_rollup", "index_key_pivot",
    "lock_summary", "plan_cache_reuse", "backup_times_of_day", "backup_activity", "config_wide",
    # orderings and running totals
    "wait_pareto", "index_work_order", "replication_latency", "ledger_current",
    # decisions and parsing
    "index_maintenance_plan", "select_by_patterns", "schedule_description", "job_step_structure", "missing_index_from_plans",
    # unions of joins
    "user_permission_audit", "role_and_grant_listing",
    # streams
    "stream_resource_tumbling", "stream_session_activity",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    times: dict[str, float] = {}
    for name in HEADLINE:
        seen = []
        for _ in range(rounds + 1):
            started = time.perf_counter()
            registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seen.append(time.perf_counter() - started)
        times[name] = round(statistics.median(seen[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
