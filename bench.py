"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from lorebook.plans import registry
from lorebook.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "bm25_topk search push_gate dense_match retrieve_fused fingerprint_match build_idf containment_join "
    "screen_gates redact_pii validate_records rights_audit_buckets advisory_audit staleness dedup_drafts assign_ids "
    "usage_counters tenant_stats quota_admission metrics_digest pilot_metrics judge_eval majority_vote attestation_rollup promote "
    "adapt guarded_batch retrieval_eval stream_usage_counters stream_tenant_calls"
).split()


def main(names: list[str]) -> None:
    spark = build_session(
        "lorebook-bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    # One small warm-up, so that the first query does not carry the JVM's start.
    queries["status_counts"](spark, SF_DIR).collect()
    times: dict[str, float] = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
