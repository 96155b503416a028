"""Imports every query module so that the registry is complete."""
from __future__ import annotations

from . import embedding_queries, feature_queries, flow_queries, storage_queries, model_queries, metric_queries, prepare_queries, profile_queries, quality_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark, sf):
    return QUERIES["risk_scoring"](spark, sf)
