"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder with the tables   (default /root/testdata/sf0.1)
BENCH_CPUS    local cores              (default 8)
BENCH_QUERIES comma-separated names, or "all"
"""

from __future__ import annotations

import json
import os
import sys
import time

from fieldloom.session import local_session
from fieldloom.workloads import QUERIES

HEADLINE = [
    "detect_hierarchy", "detect_top3_candidates", "pattern_hit_counts", "literal_autodetect", "catalogue_vote",
    "apply_rules_long", "apply_rules_joined", "resolve_sources", "resolve_in_arrays", "method_counters", "extraction_headers", "wide_export",
    "label_offset_value", "label_offset_table", "window_last_amount", "between_anchors", "date_vote", "multi_source_vote", "strategy_cascade",
    "recipe_runner", "validate_ids", "subtotal_reconcile", "lineitem_subtotal", "entity_derivation", "text_normalise",
    "nearest_value_same_row", "nearest_value_in_arrays", "column_multiline", "dedup_keep_oldest", "duplicate_files", "latest_per_name",
    "retention_plan", "assemble_text", "frequency_vote", "top2_vote", "history_page", "rule_coverage", "model_fallback", "batch_expiry",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cores, shuffle_partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's compilers and the Python workers outside the timings
    QUERIES["regex_document_test"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # noqa: BLE001  a failed query is reported, the rest still runs
            print(f"{name}: {error}", file=sys.stderr)
            times[name] = -1.0
    total = round(sum(t for t in times.values() if t >= 0), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": total, "unit": "sec", "queries": times,
                      "failed": [n for n, t in times.items() if t < 0], "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": cores}))
    spark.stop()


if __name__ == "__main__":
    main()
