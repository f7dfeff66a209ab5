"""Times the headline queries: one warm-up, then the median of three runs each.  Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from graphtables.sources.star import star_graph
from graphtables.workload import CASES, FLAGSHIP

HEADLINE = ["node_scan_filter", "node_scan_unlabeled_filter", "expand_right", "expand_multi_hop", "expand_multi_type", "expand_undirected", "cycle_close", "rel_uniqueness_anonymous", "rel_property_filter", "distinct", "topk", "group_by_implicit", "orders_by_region_and_year", "co_suppliers", "type_fn", "labels_fn"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    graph = star_graph(spark, sf_dir)
    took: dict[str, float] = {}
    for name, case in {"flagship": FLAGSHIP, **{x: CASES[x] for x in HEADLINE}}.items():
        times = []
        for _ in range(4):
            start = time.perf_counter()
            case.run(graph).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
