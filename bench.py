"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is written to the no-op sink, so the whole result is computed and nothing is collected. A short warm-up query
keeps the JVM's start out of the first measurement.
"""

from __future__ import annotations

import json
import os
import time

from riskframe.plans import QUERIES
from riskframe.session import build_session

HEADLINE = (
    "finding_confidence",
    "finding_risk",
    "overall_risk",
    "severity_status_matrix",
    "verification_queue",
    "shared_root_cause",
    "component_clusters",
    "duplicate_reports",
    "dependency_compounds",
    "correlation_ruling",
    "verification_decisions",
    "secret_scan",
    "redact_documents",
    "license_by_document",
    "injection_signals",
    "duplicate_blocks",
    "line_hash_integrity",
    "event_sequence",
    "peak_parallelism",
    "commit_activity",
    "agent_summary",
    "conflicting_specs",
    "version_gap",
    "reachability",
    "alias_groups",
    "api_diff",
    "impacts",
    "usage_inventory",
    "notification_dispatch",
    "question_routing",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(max(8, int(cpus) if cpus.isdigit() else 8)),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["severity_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
