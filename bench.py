"""Time the headline queries on one table set and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from assayer.catalog import QUERIES
from assayer.session import local_session

HEADLINES = [
    "library_clean", "failure_summary", "seven_limits",
    "consensus", "next_batch", "average_rank", "top_tenth", "remaining_library", "ledger_fold",
    "percentile_edges", "stratified_sample", "kfold", "chunks",
    "fingerprint_bits", "tanimoto_pairs", "two_stage", "knn_predict", "nearest_in_blocks", "select_start",
    "rule_counts", "composite_rank", "run_summary", "corr_matrix", "round_stats", "box_summary", "kde_grid", "fit_report",
    "atom_contacts", "structure_census", "site_rank", "section_fields",
    "library_reader", "record_reader", "progress_counts",
    "ridge_on_prints", "batch_score", "active_loop",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), "bench")
    # one untimed query starts the workers
    QUERIES["kfold"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
