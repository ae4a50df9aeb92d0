"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the input folder (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowguard.catalog import load_all  # noqa: E402
from flowguard.session import build_session  # noqa: E402

HEADLINE = [
    "preprocess_transform",
    "scale_apply",
    "split_stratified",
    "split_sink",
    "sample_exact",
    "loao_fold_counts",
    "validate_labeled",
    "quality_summary",
    "binary_metrics",
    "multiclass_metrics",
    "auroc_ovr",
    "roc_points",
    "drift_features",
    "dual_predict",
    "fusion_score",
    "score_summary",
    "slo_check",
    "latency_histogram",
    "promotion_decision",
    "window_metrics_tumbling",
    "window_psi",
    "gbt_attack_score",
    "ae_training_loss",
    "score_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(cpus, "flowguard-bench", spark__sql__shuffle__partitions=str(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registered = load_all()[0]
    # One untimed pass over a small query, so that the first timed one does not pay for the start.
    registered["label_distribution"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/"))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": scale.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
