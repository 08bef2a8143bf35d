"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names) choose the data, the cores and the queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from trailmix.plans import QUERIES
from trailmix.session import local_session

HEADLINE = ("leave_one_out", "sliding_examples", "consecutive_pairs", "ranking_metrics", "user_cosine_sim",
            "item_jaccard_sim", "random_walk_visits", "sample_negatives", "generated_list_cleanup",
            "item_content_vector", "blocked_topn", "homefeed_rank")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("trailmix-bench", cores, partitions=2 * cores, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["user_counts"](spark, folder).count()            # start the JVM's code paths
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale.group(1)) if scale else folder}))
    spark.stop()


if __name__ == "__main__":
    main()
