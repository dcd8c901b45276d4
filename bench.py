"""Seconds per headline query, as one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_REPEAT the timed runs per
query (their median counts; one run before them warms up).
"""

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    # accounts: cleaning, features, splits
    "describe_all", "clean", "features_library", "features_notebook", "stratified_split",
    "stratified_folds", "scale_train_test",
    # accounts: segments and distributions
    "kpis", "rate_by_contract", "crosstab_pct", "service_rates", "risk_segments",
    "histogram_charges", "box_stats_charges", "density_charges", "corr_matrix",
    # accounts: decisions and evaluation
    "recommendation_mix", "metrics", "roc_points", "threshold_sweep", "cumulative_gain",
    # lineitem, orders, events, documents
    "describe_lineitem", "crosstab_lineitem", "box_stats_lineitem", "metrics_lineitem",
    "cumulative_gain_lineitem", "threshold_sweep_lineitem", "histogram_orders", "rank_trials",
    "box_outliers_events", "clean_text_documents",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))

    from checks.queries import QUERIES
    from ebbline.session import build_session

    spark = build_session(f"local[{cpus}]", cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        # A sink that takes every row and column, and keeps none.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total of median seconds per query",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
