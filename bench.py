"""Wall-clock of the headline queries: one warm-up, then the median of the timed runs. Prints one JSON line.

    BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "c01_quality_dashboard", "c02_propose_mappings", "c03_profile_match", "c04_selector_evidence", "c05_classify_failures", "c06_snapshot_diff", "c08_quality_gate", "c09_scenario_status",
    "c11_triage_clusters", "c12_release_gate", "c13_metamorphic_check", "c14_event_oracle", "c15_residual_inventory", "c16_remediation_decision", "c17_cycle_guard", "c19_determinism_check",
    "c20_preservation_check", "c23_validate_contracts", "c24_merge_layers", "c25_merge_deltas", "c28_framework_portfolio", "c30_target_inventory", "c33_pr_pack", "c36_research_clusters",
    "p12_extract_actions_java", "j17_paths_in_evidence", "w07_no_progress_streak", "w09_verify_chain", "j08_rule_hits", "j18_link_failures", "p09_mask_code", "p13_extract_actions_python", "x03_normalize_source",
    "a25_method_stats", "st2_event_oracle", "st4_remediation_history",
)


def main() -> None:
    from tidemark.catalog import load
    from tidemark.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - t0)
        seconds[name] = round(statistics.median(times), 3)
    line = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf).name}
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
