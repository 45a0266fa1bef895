"""Warm wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from queries import QUERIES  # noqa: E402
from uttmill.session import local_session  # noqa: E402

HEADLINE = [
    "s1_budgeted_diverse_sample",
    "j7_deal_targets",
    "a3_build_vocab",
    "a7_error_rates",
    "a8_corpus_bleu",
    "b5_batch_by_bins",
    "f1_clean_basic",
    "j2_intersect_manifests",
    "w2_dense_index",
    "a15_ngram_counts",
    "a15_ngram_lm",
    "a16_perplexity",
    "t7_score_experiment",
    "t5_build_instruction_set",
]


def once(spark, name, folder):
    started = time.time()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.time() - started


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, cores)
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        once(spark, name, folder)
        seconds[name] = round(statistics.median(once(spark, name, folder) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "warm wall time of the headline queries, median of runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "runs": runs,
                "cores": cores,
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
