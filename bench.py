"""Time the headline queries and print one JSON line.

Folder from BENCH_SF_DIR, cores from BENCH_CPUS. Each query is run once to warm up and then
BENCH_RUNS times; the median is reported. Results are consumed by the no-op sink, so every row is
computed and none travels to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from sightline.plans import all_queries
from sightline.session import local_session

HEADLINE = (
    "fidelity_features", "mark_rate", "mean_gap", "jolly_seber", "c_hat", "gross_by_group",
    "point_grid_join", "nearest_line", "point_in_polygon", "thin_ferry",
    "curve_band_social", "pixel_median", "pixel_rwpci", "lloyd_step", "silhouette_by_k",
    "wss_by_k", "pair_join", "cluster_labels", "poisson_intensity_fit",
)


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    times = {}
    for key in HEADLINE:
        run(queries[key], spark, folder)
        times[key] = round(statistics.median(run(queries[key], spark, folder) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "warm_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
