"""The exploration report: analyzers, one summary of their tables, insights, a headline, all in one JSON file beside
the tables, and the hints a feature run reads back from it."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations as rel
from ..session import bounded_collect
from ..store import files
from ..store.tables import write_report_tables
from . import flows

REPORT = "report.json"


def _first(df: DataFrame, *order) -> dict:
    row = df.orderBy(*order).limit(1).collect()
    return row[0].asDict() if row else {}


def summary_of(tables: dict[str, DataFrame], n_rows: int, n_cols: int) -> dict:
    """What the insight rules look at, out of the tables that are there; an absent analyzer leaves its values out.
    Every table has a row per feature, or one row."""
    out: dict = {"n_rows": n_rows}
    if "target" in tables:
        out["imbalance_ratio"] = tables["target"].first()["imbalance_ratio"]
    if "missing" in tables:
        row = tables["missing"].agg(F.count("*").alias("n"), F.coalesce(F.sum("missing_count"), F.lit(0)).alias("cells")).first()
        out.update(n_features_with_missing=row["n"], overall_missing_pct=row["cells"] * 100.0 / max(n_rows * n_cols, 1))
    if "distributions" in tables:
        row = tables["distributions"].agg(F.count_if("highly_skewed").alias("s"), F.count_if("heavy_tailed").alias("h")).first()
        out.update(n_highly_skewed=row["s"], n_heavy_tailed=row["h"])
    if "correlation" in tables:
        out["n_high_pairs"] = rel.high_pairs(tables["correlation"]).count()
    if "inflation" in tables:
        out["n_high_vif"] = tables["inflation"].filter("vif > 10").count()
    if "outliers" in tables:
        out["mean_iqr_outlier_pct"] = tables["outliers"].agg(F.avg("iqr_outlier_pct")).first()[0]
    if "anomalies" in tables:
        out["anomaly_pct"] = tables["anomalies"].first()["anomaly_pct"]
    if "ratios" in tables:
        out["top_discriminative"] = _first(tables["ratios"], F.desc("abs_cohens_d"), "feature").get("feature")
        out["best_category"] = _first(rel.category_strength(tables["ratios"]), F.desc("mean_abs_d"), "category").get("category")
    if "relationships" in tables:
        out["best_feature"] = _first(tables["relationships"], F.desc_nulls_last("separability"), "feature").get("feature")
        out["mean_separability"] = tables["relationships"].agg(F.avg("separability")).first()[0]
    if "dimensionality" in tables:
        row = tables["dimensionality"].agg(F.count("*").alias("n"), F.count_if(F.col("cumulative_variance") < 0.95).alias("below")).first()
        out.update(n_features=row["n"], n_components_95pct=min(row["below"] + 1, row["n"]))
    return {k: v for k, v in out.items() if v is not None}


def insights_of(spark: SparkSession, summary: dict) -> DataFrame:
    return flows.insights(spark.createDataFrame([tuple(summary.values())], list(summary)))


def hints_of(tables: dict[str, DataFrame]) -> dict:
    """Suggestions for the feature run, whole lists; an absent table suggests nothing."""
    names = lambda df, *order: [r["feature"] for r in bounded_collect(df.orderBy(*order).select("feature"))]
    out: dict = {"skewed_features": [], "high_correlation_pairs": [], "high_vif_features": [], "top_discriminative": []}
    if "distributions" in tables:
        out["skewed_features"] = names(tables["distributions"].filter("highly_skewed"), "feature")
    if "correlation" in tables:
        out["high_correlation_pairs"] = [[r["feature_a"], r["feature_b"], r["r"]] for r in bounded_collect(rel.high_pairs(tables["correlation"]))]
    if "inflation" in tables:
        out["high_vif_features"] = names(tables["inflation"].filter("vif > 10"), F.desc("vif"), "feature")
    if "ratios" in tables:
        out["top_discriminative"] = names(tables["ratios"], F.desc("abs_cohens_d"), "feature")
    return out


def write_report(df: DataFrame, target: str, key: str, folder: str, skip: Sequence[str] = (), only: Sequence[str] | None = None) -> dict:
    """Run the analyzers (all, or those named, in that order), write their tables as CSV and ``report.json``; returns
    the report.  A failed analyzer is in the report with its error and has no part in summary, insights and hints."""
    spark = df.sparkSession
    tables, status = flows.explore(df, target, key, skip, only)
    paths = dict(zip(tables, write_report_tables({f"{name}__table": t for name, t in tables.items()}, folder)))
    summary = summary_of(tables, df.count(), len(df.columns))
    found = insights_of(spark, summary)
    report = {
        "meta": {"target": target, "n_rows": summary["n_rows"], "n_cols": len(df.columns), "n_run": len(tables), "n_failed": status.count() - len(tables)},
        "analyzers": [{**r.asDict(), "table": paths.get(r["analyzer"])} for r in status.collect()],
        "summary": summary,
        "insights": {"headline": flows.headline(found), "items": [r.asDict() for r in found.collect()]},
        "hints": hints_of(tables),
    }
    files.write_json(spark, f"{folder}/{REPORT}", report)
    return report


def load_report(spark: SparkSession, folder: str) -> dict:
    return files.read_json(spark, f"{folder}/{REPORT}", {})


def load_hints(spark: SparkSession, folder: str) -> dict:
    """Hints of a written report; none where there is no report."""
    return load_report(spark, folder).get("hints", {})
