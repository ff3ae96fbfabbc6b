"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Labelling the phantom, whose size is its own, is not in the total."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from histospark import queries
from histospark.operators import components
from histospark.sources.images import size_phantom

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Width of the phantom whose disks are labelled.
PHANTOM = int(os.environ.get("BENCH_PHANTOM", "4096"))
HEADLINE = [
    "entity_boxes", "label", "area_threshold", "reconstruct", "reconstruct_tiled", "fill_holes", "distance", "opening", "gradient",
    "bgr2gray", "color_deconv", "histogram_statistics", "load_statistics", "shape_features", "cytoplasm_intensity", "log_by_name",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS))).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    phantom = size_phantom(spark, PHANTOM).where("v > 0")
    runs = {name: (lambda name=name: queries.QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
    runs[f"label_phantom_{PHANTOM}"] = lambda: components.label(phantom, PHANTOM, 4)
    for name in ("label", "gradient", "distance"):  # start what starts once: code, Python workers
        runs[name]().write.format("noop").mode("overwrite").save()
    took = {}
    for name, run in runs.items():
        began = time.time()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(took[name] for name in HEADLINE), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rpartition("sf")[2], "cpus": int(CPUS), "shuffle_partitions": 2 * int(CPUS)}))


if __name__ == "__main__":
    main()
