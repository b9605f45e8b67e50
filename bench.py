"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Each query is executed to completion with the ``noop`` sink (full computation,
no driver collect). The spatial index is built once up front (``index_build``)
and reused by the spatial queries, as a job over the same polygon tables would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "transform_locations",
    "grid_heatmap",
    "dataset_statistics",
    "label_distributions",
    "device_day_summary",
    "device_stats",
    "operator_groups",
    "speed_percentiles",
    "fact_locations",
    "district_assignment",
    "district_statistics",
    "top_districts",
    "parcel_assignment",
    "incremental_etl_grid",
    "stream_ingest_grid",
    "device_day_job",
    "quadtree_assignment",
    "pyramid_district_statistics",
    "pyramid_district_one",
    "speed_percentiles_by_days",
    "nearest_district",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from geoping.session import local_session
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")),
                          app="geoping-bench")
    from geoping.plans import catalog

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    # warm-up: JVM, parquet footers, codegen caches
    run(catalog.pings(spark, sf_dir).select("id"))

    times: dict[str, float] = {}
    t0 = time.time()
    catalog.both_index(spark, sf_dir)
    times["index_build"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        t0 = time.time()
        run(catalog.QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
