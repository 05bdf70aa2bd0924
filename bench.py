"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from provspark.plans import load_queries  # noqa: E402
from provspark.session import build_session  # noqa: E402

HEADLINE = [
    "m14_equal_fpr_compare", "m10_benchmark", "a06_threshold_group_mean", "a05_threshold_quantile", "a08_auc",
    "a09_tpr_at_fpr", "a10_group_metrics", "a42_fpr_curve", "a39_exclusion_summary", "a27_spearman",
    "a13_balanced_weights", "a15_equalise_covariate", "p04_admit", "p04_admit_with_quota", "p05_admission_funnel",
    "p09_tombstone", "w01_quota", "w03_chrono_holdout", "w04_carry_caption", "w05_pair_tokens", "w10_greedy_group_split",
    "x01_hash_split", "j01_inherit_split", "j10_nearest_cosine", "j11_nearest_hamming", "j12_near_pairs",
    "j18_contaminated_train", "m01_extract_features", "m02_score_heads", "m15_leader_clusters", "m16_connected_groups",
    "z01_admit_stream",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = load_queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # session start-up is not measured
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
