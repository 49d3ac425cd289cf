"""Warm wall seconds of the headline queries, median of three; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from corpusmill.plans.queries import QUERIES
from corpusmill.session import session

HEADLINE = ("validate_first_failure", "exact_dedup", "near_dup_greedy", "overlap_contains", "stratified_group_split", "vector_topk", "issue_rollup", "generation_summary")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = session(cores, int(cores), os.environ.get("BENCH_MEMORY", "8g"))
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3")) + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "headline queries, warm median", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
