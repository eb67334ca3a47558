"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.operators import polygons
from tessella.operators.grid import GridSpec
from tessella.plans import catalog, generate

HEADLINE = ["weights_native_per_source", "weights_fallback_area", "apply_extensive", "apply_intensive", "apply_ratio", "apply_checked", "window_means_multi", "pooled_mean_quantiles", "pooled_weighted_quantiles", "summarize_samples_end_to_end", "box_zonal_exact", "box_zonal_centroid", "gradient_aggregate", "compare_outputs_report", "polygon_cells", "polygon_overlay", "polygon_zonal_exact", "grid_weight_generation"]


ZONES = "SELECT c_custkey, CAST((c_custkey * 7919) % 35800 AS DOUBLE) / 100 - 179 AS x0, CAST((c_custkey * 104729) % 15800 AS DOUBLE) / 100 - 80 AS y0 FROM {customer}"


def zone_weights(spark: SparkSession, sf: str) -> dict:
    """Area weights of half-degree cells in a box of 1.3 by 0.9 degrees for each customer, from polygons to checked weights; what it counted."""
    boxes = catalog.sql(spark, sf, ZONES).withColumn("x1", F.col("x0") + 1.3).withColumn("y1", F.col("y0") + 0.9)
    artifact = generate.weights_on_grid(polygons.boxes(boxes, ["c_custkey"]), ["c_custkey"], GridSpec(0.5), [generate.Weight("area")])
    return {"polygons": boxes.count(), "segments": artifact.frame.count()}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, found = catalog.queries(), {}
    queries[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        found[name] = round(time.time() - start, 3)
    start = time.time()
    counted = zone_weights(spark, sf)
    found["zone_weight_generation"] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf, "zone_weight_generation": counted}))


if __name__ == "__main__":
    main()
