"""Wall time of headline queries. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
BENCH_QUERIES (comma-separated names, default the list below).
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import QUERIES
from tidemark.session import build_session, default_cpus

HEADLINE = (
    "forecast_dataset", "flatten_entities", "multi_slice_counts", "slice_asof", "asof_lookup", "investor_reputation",
    "team_experience", "fuzzy_match", "stale_or_missing", "dedup_latest", "clean_features", "topn_dummies", "pair_sum",
    "success_rate", "stage_transition", "descriptives_by_stage", "classifier_stats", "rank_candidates", "cumulative_share",
    "column_profile", "corr_thresholds", "corr_spearman", "normality_k2", "roc_curve", "class_report", "standardize_names",
    "doc_normalize", "csv_roundtrip", "knn_vote", "clf_lr", "clf_rf",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = default_cpus()
    spark = build_session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=str(cpus), spark_ui_enabled="false",
                          spark_ui_showConsoleProgress="false", spark_driver_memory="16g")
    spark.conf.set("spark.sql.shuffle.partitions", str(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    # Start the executor threads, the code generator and the planner before the clock.
    for name in ("entity_age", "entity_stage"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count() + spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "forecast_rows_per_sec": round(rows / took["forecast_dataset"]) if "forecast_dataset" in took else None,
    }))


if __name__ == "__main__":
    main()
