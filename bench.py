"""Times the headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from orolith import catalog
from pyspark.sql import SparkSession

HEADLINE = (
    "class_area", "boundary_mask", "local_std5", "entropy3", "edt", "elev_bins", "score_topk", "region_members", "region_attributes",
    "plane_moments", "recursive_fit", "vehicle_step", "adjacency", "region_edges", "path_report", "recon_loss", "mean_iou",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    catalog.queries()["class_area"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is no query's
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
