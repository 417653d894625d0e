"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "A1_pixel_scan", "B8_qc_flags", "C1_white_tophat", "C2_otsu_threshold", "C4_dilation_ring", "C6_connected_components", "C13_glcm_texture", "C18_cell_crops",
    "D1_ring_intensity", "D6_nuclear_partition", "D11_moment_shape", "E1_residualisation", "E4_composite_score_pc1", "E7_combat",
    "E13_correlation_matrix", "E14_cross_block_screen", "E19_two_condition_comparison", "E20_mann_whitney_p", "E24_nearest_rank_groups", "E27_top_deviations", "E29_power_scan",
    "F1_spatial_knn", "F5_graph_propagation", "F10_cosine_knn", "F14_cross_block_prediction", "G3_shortest_paths", "G7_shift_ranking", "G15_dynamic_rerank",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from cytofleet.plans import catalogue
    from cytofleet.session import build_session

    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # warm the JVM, so that the first query does not pay for start-up
    catalogue.QUERIES["D6_nuclear_partition"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, failed = {}, {}
    for n in names:
        t = time.perf_counter()
        try:
            catalogue.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - one query must not cost the others their figures
            failed[n] = str(e)[:300]
            print(n, "failed:", failed[n], file=sys.stderr, flush=True)
            continue
        times[n] = round(time.perf_counter() - t, 3)
        print(n, times[n], file=sys.stderr, flush=True)
    cells = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() / 1e6
    px = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() * 64 / 1e6
    # seconds per million input rows: run at two sizes to see how a query scales
    per_pixel = {n for n in times if n[0] in "CD" or n.startswith(("A1_", "S1_"))}
    rate = {"sec_per_million_pixels": {n: round(t / px, 3) for n, t in times.items() if n in per_pixel},
            "sec_per_million_cells": {n: round(t / cells, 3) for n, t in times.items() if n not in per_pixel}}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "failed": failed, **rate}))
    spark.stop()


if __name__ == "__main__":
    main()
