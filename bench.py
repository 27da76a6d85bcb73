"""Headline timings: prints one JSON line.

Every query is written to the no-op sink, so its whole result is computed. Stage
outputs (the encoded matrix, the masked cells) are written once by the step named
``stage_*``; later steps read them, as the stages of a study do.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

STEPS = [
    "c16_harmonise_chain", "d1_missingness_table", "d3_classify_columns", "d6_codebook", "e1_fit_canonical",
    "e6_fit_quantiles", "e7_to_uniform", "f6_tail_rules", "f9_nested_mask", "g2_mean_mode", "g10_mixed_vote",
    "g13_snap_to_valid", "h5_all_arms", "h7_fidelity_summary", "i3_split_binary", "i4_model_matrix", "i10_roc_auc",
    "i11_average_precision", "i8_best_threshold", "j6_pairwise_wilcoxon", "j9_ranked_families", "k3_box_summary",
    "g6_predictor_screen", "g3_knn_vectors", "g3_knn_registry",
]


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from catalog import base, flagship, load_all

    queries, _ = load_all()
    times: dict[str, float] = {}

    def clock(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    def drain(frame):
        frame.write.format("noop").mode("overwrite").save()

    spark.range(1000).selectExpr("sum(id)").collect()  # start the JVM's workers
    clock("stage_encoded", lambda: base.encoded(spark, SF_DIR))
    clock("stage_masked", lambda: flagship.masked_cells(spark, SF_DIR))
    for name in STEPS:
        clock(name, lambda: drain(queries[name](spark, SF_DIR)))
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
