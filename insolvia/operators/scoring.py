"""Batch (or streaming) scoring of probabilities, and operational request metrics.

``score`` is row-local, so the same function runs on a static table and on a stream.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import confidence, risk_band, risk_score, rounded_even


def risk_columns(df: DataFrame, probability: str = "probability", scale: float = 100.0) -> DataFrame:
    """Risk score, probability to four digits and the band of the rounded score."""
    scored = df.withColumn("risk_score", risk_score(probability, scale))
    return scored.withColumns({"risk_level": risk_band("risk_score", scale), "probability": rounded_even(probability, 4)})


def score(
    df: DataFrame, probability: str, threshold: float, model_version: str, algorithm: str, scored_at: Column, key: str = "id", scale: float = 100.0
) -> DataFrame:
    """The full scored-row contract."""
    p = F.col(probability)
    risk = risk_score(p, scale)
    return df.select(
        F.col(key).alias("id"),
        F.when(p >= F.lit(float(threshold)), 1).otherwise(0).alias("prediction"),
        rounded_even(p, 6).alias("probability"),
        risk.alias("risk_score"),
        risk_band(risk, scale).alias("risk_level"),
        rounded_even(confidence(p, threshold), 4).alias("confidence_score"),
        rounded_even(F.lit(float(threshold)), 6).alias("threshold"),
        F.lit(model_version).alias("model_version"),
        F.lit(algorithm).alias("algorithm"),
        scored_at.alias("prediction_timestamp"),
    )


REQUEST_METRICS = ("request_count", "prediction_count", "error_count", "avg_latency_ms", "avg_inference_ms")


def request_aggregates() -> list[Column]:
    """Counters over a request log (kind, latency_ms, is_error, predictions, inference_ms)."""
    request = F.col("kind") == "request"
    call = F.col("kind") == "prediction"
    return [
        F.count_if(request).alias("request_count"),
        F.coalesce(F.sum(F.when(call, F.col("predictions"))), F.lit(0)).alias("prediction_count"),
        F.count_if(request & F.col("is_error")).alias("error_count"),
        rounded_even(F.coalesce(F.avg(F.when(request, F.col("latency_ms"))), F.lit(0.0)), 3).alias("avg_latency_ms"),
        rounded_even(F.coalesce(F.avg(F.when(call, F.col("inference_ms"))), F.lit(0.0)), 3).alias("avg_inference_ms"),
    ]


def request_snapshot(log: DataFrame, model_version: str) -> DataFrame:
    return log.agg(*request_aggregates()).withColumn("active_model_version", F.lit(model_version))


def list_models(registry: DataFrame, best_version: str) -> DataFrame:
    """Registered models with their test metrics and a flag on the best one."""
    return registry.withColumn("is_best", F.col("model_version") == F.lit(best_version)).orderBy("model_version")


def linear_contributions(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Mean absolute contribution |w * (x - mean)| per feature of a linear model."""
    cols = list(coefficients)
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    row = df.agg(*[F.avg(F.abs(F.lit(float(coefficients[c])) * (F.col(c) - F.lit(means[f"m{i}"])))).alias(f"v{i}") for i, c in enumerate(cols)])
    return row.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("mean_abs_contribution")) for i, c in enumerate(cols)])).alias("s")
    ).select("s.*")
