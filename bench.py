"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts. Results are
written to the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillmill.queries import QUERIES  # noqa: E402
from quillmill.session import local_session  # noqa: E402

HEADLINE = [
    "chunk_text",
    "keywords",
    "synthesize_qa",
    "dedupe_pairs",
    "prepare_text_dataset",
    "quality_report",
    "split_train_eval",
    "stratified_split",
    "turns_to_pair",
    "recent_turns",
    "tokenize_and_mask",
    "pack_sequences",
    "per_class_report",
    "ovr_auc",
    "roc_auc",
    "token_f1",
    "rouge",
    "corpus_bleu",
    "log_events",
    "loss_trend",
    "text_verdict",
    "best_fit_match",
]


def timed(run, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    seconds = {}
    for name in names:
        timed(QUERIES[name], spark, sf_dir)
        seconds[name] = round(statistics.median(timed(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
    line = {
        "metric": "sum of median warm query seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
