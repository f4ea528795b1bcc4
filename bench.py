"""Bench: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and print one JSON line.

Each query is executed to completion with the no-op sink (every row is produced,
nothing is collected to the driver).  Session start-up and a warm-up pass on the
smallest data set are not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chi2_pairs",
    "label_cooccurrence",
    "labelset_counts",
    "strat_label_powerset",
    "tr_prune_ppt",
    "ev_all",
    "ln_binary_relevance",
    "ln_classifier_chain",
    "ln_label_powerset",
    "ln_calibrated_ranking",
    "knn_neighbors",
    "ln_mlknn",
    "ln_rakel",
    "ev_cross_validate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from polytag.session import build_session
    from polytag.plans.queries import QUERIES

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="polytag-bench")
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for n in names[:3]:
            QUERIES[n](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf, "cpus": int(cpus), "spark": spark.version,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
