"""Headline queries, timed end to end: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "d1_segment_intent", "d2_intent_summary", "b1_filler_removal", "b6_context_windows", "b9_preprocess",
    "b9_stage_metrics", "b13_entity_hints", "b20_category_detection", "c3_exact_cascade", "c6_batch_resolve",
    "c13_calibration", "c16_co_occurrence", "e1_seasonal_context", "e4_quality_estimate", "e10_category_potential",
    "e19_vertical_detection", "e23_feedback_fold", "f7_opportunities", "f11_internal_convergence", "f13_affinity",
    "f33_product_clusters", "f40_calendar_window", "g1_rate_limit_offered", "g4_overview", "g11_budget_ledger",
    "g12_token_bucket", "h4_evaluation", "s1_windowed_calls", "s3_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from shelfsight.plans import catalog
    from shelfsight.session import local_session
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        t = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
