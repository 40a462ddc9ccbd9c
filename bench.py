"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads.
Each query runs once to warm up and then BENCH_RUNS (default 2) times; the least time counts. Results go to a sink that reads
every row and column. ``cube_100`` is the zip, product and reduction over 100**3 cells in native bodies, ``cube_100_batch`` in
bodies called with whole batches, ``cube_50_python`` in bodies called cell by cell.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = (
    "map_elementwise map_multi_output zip_two_arrays broadcast_align mixed_zip_product reduce_partial reduce_multi_axis reduce_full reduce_chain contraction ordered_reduce "
    "growing_axis fixed_slice resume_missing count_sweep table_assembly error_propagate_reduce nested_fuse memo_dedupe pandas_udf_map opaque_reduce session_windows"
).split()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from axisloom.queries import CATALOGUE, cube_flow, sweep_cube

    jobs = {name: (lambda f=CATALOGUE[name][0]: f(spark, FOLDER)) for name in HEADLINE}
    for n in (50, 100, 200):
        jobs[f"cube_{n}"] = lambda n=n: sweep_cube(spark, FOLDER, n)
    for kind, n in (("batch", 50), ("batch", 100), ("python", 50)):  # the same sweep through bodies that Spark can't see into
        jobs[f"cube_{n}_{kind}"] = lambda n=n, kind=kind: sweep_cube(spark, FOLDER, n, kind)
    assert cube_flow()
    took: dict[str, float] = {}
    for name, job in jobs.items():
        best = float("inf")
        for k in range(RUNS + 1):
            began = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            if k:
                best = min(best, time.perf_counter() - began)
        took[name] = round(best, 4)
    cells = {f"{name}_cells_per_s": round(int(name.split("_")[1]) ** 3 / s) for name, s in took.items() if name.startswith("cube_")}
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": FOLDER.rsplit("sf", 1)[-1], "cpus": int(CPUS), **cells}))
    spark.stop()


if __name__ == "__main__":
    main()
