"""Times the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import time

from tidewatch.plans import catalog
from tidewatch.session import local_session

HEADLINE = (
    "overall_2x2", "wilson_ci", "stratified_metrics", "version_summary", "missing_profile", "multiclass_summary", "auroc", "auprc", "roc_points", "brier_ece", "calibration_fit", "psi",
    "wasserstein_ks", "rolling_auroc", "site_calibration_drift", "version_pairs_join", "delong_components", "alerts", "alias_adapter",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    queries["overall_2x2"](spark, sf_dir).collect()  # the session's start is not a query's
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
