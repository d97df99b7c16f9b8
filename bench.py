"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from brickloom.plans.catalogue import QUERIES

HEADLINE = [
    "inventory_counts", "top_inventory", "catalog_search", "dominant_theme", "taxonomy_counts", "merge_sets",
    "set_theme_lookup", "sequence_index", "std_steps", "training_examples", "ldraw_parts", "ldraw_encode",
    "contact_pairs", "collision_pairs", "blocked_pairs", "subassemblies", "gravity_check", "com_stable",
    "interlock_score", "vehicle_metrics", "voxel_pack", "page_assignment", "disassembly_order", "cadence_state",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "20g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["part_dims"](spark, sf).write.format("noop").mode("overwrite").save()  # warm up the session
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
