"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full (noop sink, nothing collected) after an untimed
warm-up of the same query on the sf0.001 tables (JIT and codegen only; no data
of the timed run is touched); prints one JSON line with seconds per query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "dom_summary_table",
    "dom_region_stats_adj",
    "dom_mean_annual_supply",
    "dom_population_supplied",
    "dom_kobo_trips",
    "dom_yield_by_group",
    "dom_density_by_habitat",
    "dom_affordability",
    "dom_flow_axes",
    "ml_lloyd_kmeans_gn",
    "sta_permanova_gn",
    "dom_profile_ci_ag",
    "ml_tune_gn",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from nutriyield.plans.catalog import QUERIES
    from nutriyield.session import get_spark
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, app_name="nutriyield-bench", driver_memory="16g")
    names = sys.argv[1:] or HEADLINE
    # warm-up (untimed): each query once on the smallest tables, so JIT and
    # codegen of its operators are done, as on long-running cluster executors.
    # A different folder: nothing of the timed run is cached or reused.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        for n in names:
            QUERIES[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
