"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_ONLY    comma-separated query names to run instead of the default list
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from insolvia.plans import catalog  # noqa: E402
from insolvia.session import build_session  # noqa: E402

HEADLINE = [
    "firm_features", "missing_by_column", "duplicate_rows", "natural_key_duplicates", "iqr_outlier_share", "zscore_outlier_share", "value_rules",
    "series_not_chronological", "series_gaps", "descriptive_statistics", "pearson_matrix", "spearman_matrix", "univariate_auc", "mutual_information",
    "winsorize", "scale_robust", "impute_median", "onehot_encode", "deduplicate_keep_last", "stratified_split", "time_split", "rolling_volatility",
    "feature_generation", "selection_vote", "full_evaluation", "company_facts", "batch_scoring", "fit_logistic_regression", "fit_random_forest", "fit_naive_bayes",
    "risk_scoring", "fit_decision_tree", "fit_knn", "impute_nearest_neighbours", "corpus_findings", "ordinal_encode_many",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().count()  # start the engine before timing
    took = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
