"""Time the headline queries: ``BENCH_SF_DIR`` (tables) and ``BENCH_CPUS`` (cores). Prints one JSON line."""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from strandlab import catalog  # noqa: E402
from strandlab.session import local_session  # noqa: E402

HEADLINE = [
    "a02_five_numbers_of_prices",
    "a02_quantiles_of_prices",
    "a05_mean_std",
    "a11_step_ranges",
    "c01_kmeans",
    "c01_kmeans_over_blocks",
    "c01_three_lloyd_steps",
    "c04_adjusted_rand",
    "c07_calinski_harabasz",
    "c09_silhouette",
    "c10_scores_by_model_and_seed",
    "c10_cluster_and_evaluate",
    "c11_seed_sweep_scores",
    "f15_min_max_steps",
    "f19_standardise",
    "j04_nearest_centre",
    "k06_macro_scores_of_flags",
    "k07_classify_and_evaluate",
    "k07_margin_evaluation",
    "p06_drop_singletons",
    "p07_stratified_split",
    "p08_split_plan",
    "prepare_all",
    "r01_recurrent_lstm",
    "r03_conv_encoder",
    "r06_interval_features",
    "r07_mixed_rows_beta",
    "r08_contrastive_loss",
    "r13_gram_sums",
    "r13_student_fit",
    "r16_extract_representations",
    "s01_read_arff",
    "t02_friedman",
    "t05_ranks_with_significance",
    "t06_wilcoxon",
    "t08_summary_table",
    "w05_early_stop",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session("strandlab-bench", cpus=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    # start the Python workers, read every table once and compile common plans, so that the first query is not charged for it
    for name in ("r03_conv_encoder", "a05_mean_std", "a02_five_numbers_of_prices"):
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    # a fixed job that reads nothing: how fast the machine is just now
    start = time.time()
    spark.range(0, 200_000_000, numPartitions=8).selectExpr("sum((id * 31) % 7)").collect()
    control = round(time.time() - start, 3)
    times = {}
    for name in wanted:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    scale = pathlib.Path(folder).name.removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "control_seconds": control, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
