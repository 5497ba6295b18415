"""Headline queries, timed: prints one JSON line.

A small query warms the JVM first; then each query is timed once, from building its plan to writing
its last row to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "at6_interval_join",
    "at0_policy_totals",
    "at21_span_rollup",
    "ij5_coverage_islands",
    "ij9_guarded_sums",
    "ij11_combined_total",
    "sm4_grouping_sets",
    "rq1_session_summaries",
    "rq2_telemetry_gap",
    "es6_estimate",
    "val1_outcomes",
    "ot7_ordered_claim",
    "lc1_hook_pairs",
    "ct3_session_split",
    "vw2_neighbourhood",
    "snk1_new_facts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from wattledger import catalog
    from wattledger.session import local_session

    spark = local_session(cpus, "16g")
    queries = catalog.queries()

    def run(name: str) -> float:
        begun = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    run("rq1_session_summaries")
    seconds = {}
    for name in names:
        seconds[name] = round(run(name), 3)
        print(f"\n{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
