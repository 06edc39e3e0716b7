"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pointengine.queries import QUERIES  # noqa: E402

HEADLINE = ("cmp_subfield", "cmp_scaled_raw", "dsl_compare", "cmp_plain", "dsl_right_assoc", "header_bounds", "dim_stats", "returns_histogram", "box_3d", "copc_query", "octree_prune", "knn_k5", "waveform_gather", "convert_format", "change_scaling", "write_roundtrip")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    tmp = tempfile.mkdtemp(prefix="bench-")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.local.dir", tmp).config("spark.sql.warehouse.dir", f"{tmp}/wh").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()  # warm up
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
