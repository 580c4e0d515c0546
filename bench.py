"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lattix.plans.catalog import queries
from lattix.session import local_session

HEADLINE = ("aggregate", "time_group", "points_in_polygons", "block_weights", "distance_band", "nearest_neighbours", "spatial_lag", "local_moran", "global_moran", "local_geary", "getis_ord_g", "local_moran_permutation", "spatial_empirical_bayes", "quantile_map", "ols_coefficients", "dbscan", "kmeans")


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cpus, 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            queries()[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(d).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
