"""Times headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

HERE = str(Path(__file__).resolve().parent)
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])  # for Python workers

HEADLINE = [
    "ndvi_zonal_stats", "b01_band_math", "b04_spectral_indices", "d01_raster_statistics", "d04_segment_features", "d06_post_classification_change",
    "e01_mean_blur", "e02_median_blur", "e08_majority_filter", "h06_change", "h08_otsu", "h09_fusion_linear", "h10_fusion_brovey", "h11_fusion_pca",
    "h12_fusion_ihs", "h13_fusion_gram_schmidt", "h14_pca", "h16_sam", "h22_rx_anomaly", "c03_boxes_intersect", "c04_nearest", "j04_clump",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from gridloom.plans.all import QUERIES

    QUERIES["ndvi_zonal_stats"](spark, sf).collect()  # warm-up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
