"""Times the headline queries. One JSON line: median of the timed runs after a warm-up, in seconds."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import REGISTRY  # noqa: E402
from corpuslens.session import build_session  # noqa: E402

HEADLINE = (
    "score_repos", "match_rules", "dedup_issues", "nested_loops", "chunk_files", "retrieve_chunks",
    "latest_patches", "severity_counts", "owned_analyses", "css_checks", "corpus_scores", "build_chunk_index",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    # The noop sink computes every column of every row and writes nothing.
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline queries, sum of median wall seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cores,
    }))


if __name__ == "__main__":
    main()
