"""A whole feature run whose fitted state is one JSON document.

``fit_features`` learns every stage on the train rows and returns plain lists, numbers and texts; ``replay`` turns any
table with the source columns into the same features, by projections alone.  ``run_features`` stores the rows of all
splits together with that document as one version of a feature store, and ``replay_version`` applies a stored one.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import numeric_columns
from ..operators import features as ft
from ..operators import models as md
from ..operators.prepare import enforce_features
from ..session import bounded_collect, materialize
from ..store.tables import FeatureStore


@dataclass(frozen=True)
class Settings:
    """The stages' defaults.  A stage whose setting is None is left out."""

    base: int = ft.BASE_FEATURES
    ratios: int | None = ft.MAX_RATIOS  # None: every pair of the base set
    interactions: int | None = ft.MAX_INTERACTIONS
    differences: int | None = ft.MAX_DIFFERENCES
    correlation: float | None = 0.95
    inflation: float | None = 10.0
    variance: float | None = 1e-8
    relevance: float | None = 0.0
    min_votes: int | None = 2
    top_k: int = 40
    eliminate_to: int | None = 30
    forest_trees: int | None = 200
    reduction: str | None = "pca"  # or "svd"
    mode: str = "append"  # or "replace"
    variance_kept: float = 0.95
    importance_trees: int | None = 300
    seed: int = 42


def _train(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")


def _survivors(train: DataFrame, columns: list[str], target: str, s: Settings) -> tuple[list[str], dict[str, list[str]]]:
    """Columns that pass the selectors, and what each selector removed; a selector sees what the ones before it left."""
    left, removed = list(columns), {}

    def keep(selector: str, kept: Sequence[str]) -> None:
        nonlocal left
        stays = set(kept)
        removed[selector] = [c for c in left if c not in stays]
        left = [c for c in left if c in stays]

    if s.variance is not None:
        low = {r["feature"] for r in bounded_collect(ft.low_variance(train, left, s.variance).filter("dropped"))}
        keep("variance", [c for c in left if c not in low])
    if s.relevance:
        weak = set(ft.relevance_floor(train, left, target, s.relevance))
        keep("relevance", [c for c in left if c not in weak])
    if s.min_votes is not None and left:
        keep("vote", [r["feature"] for r in bounded_collect(ft.vote(ft.voters(train, left, target, s.top_k), s.min_votes))])
    if s.eliminate_to is not None and len(left) > 2:
        keep("elimination", md.recursive_elimination(train, left, target, s.eliminate_to))
    if s.forest_trees is not None and len(left) > 2:
        keep("forest", md.select_by_forest(train, left, target, s.forest_trees, s.seed))
    return left, removed


def fit_features(df: DataFrame, target: str, keep: Sequence[str], hints: dict | None = None, settings: Settings | None = None) -> dict:
    """Fit generation, multicollinearity, selection, reduction and importance on the train rows of a table with a
    ``split`` column.  ``keep`` are columns carried along that are no features; so are columns that are not numeric.

    Without train rows, or with fewer than two numeric features, there is nothing to select from: ValueError.
    """
    s = settings or Settings()
    sources = [c for c in numeric_columns(df) if c not in {target, "split", *keep}]
    if len(sources) < 2:
        raise ValueError(f"a feature run needs two numeric features or more, found {sources}")
    train = materialize(_train(df).select(target, *sources), "feature-train")
    rows = train.count()
    if not rows:
        raise ValueError("a feature run needs train rows")
    trail: list[tuple] = []
    state = {"target": target, "keep": list(keep), "sources": sources, "settings": asdict(s)}

    state["plan"] = plan = ft.plan_features(train, sources, hints, base_size=s.base, limits=(s.ratios, s.interactions, s.differences))
    train = md.compact(materialize(ft.apply_features(train, plan), "feature-generated"), rows)
    current = sources + plan["generated"]
    trail.append(("generation", len(sources), len(current), len(plan["generated"]), 0))

    apart: dict[str, list[str]] = {}
    left = current
    if s.correlation is not None:
        apart["correlation"] = ft.correlation_filter(train, left, target, s.correlation)
        left = [c for c in left if c not in set(apart["correlation"])]
    if s.inflation is not None:
        apart["inflation"] = ft.vif_elimination(train, left, s.inflation)[0]
        left = [c for c in left if c not in set(apart["inflation"])]
    trail.append(("multicollinearity", len(current), len(left), 0, len(current) - len(left)))

    selected, chosen = _survivors(train, left, target, s)
    trail.append(("selection", len(left), len(selected), 0, len(left) - len(selected)))
    state["removed"], state["selected"] = apart | chosen, selected

    state["projection"], final = None, selected
    if s.reduction is not None and len(selected) >= 3:
        fitted = (md.fit_svd if s.reduction == "svd" else md.fit_pca)(train, selected, variance=s.variance_kept)
        state["projection"] = {**fitted, "components": fitted["components"].tolist(), "ratio": [float(v) for v in fitted["ratio"]], "shift": [float(v) for v in fitted["shift"]], "mode": s.mode}
        k = fitted["components"].shape[1]
        scores = [f"{fitted['kind']}__{j + 1}" for j in range(k)]
        final = scores if s.mode == "replace" else selected + scores
        trail.append(("reduction", len(selected), len(final), k, len(selected) if s.mode == "replace" else 0))
    state["features"] = final

    state["importance"] = []
    if s.importance_trees is not None and final:
        reduced = md.compact(materialize(_reduced(train, state).select(target, *final), "feature-reduced"), rows)
        scored = md.combined_importance(reduced, final, target, s.importance_trees, s.seed)
        state["importance"] = sorted((r.asDict() for r in bounded_collect(scored)), key=lambda r: (r["mean_rank"], r["feature"]))
        trail.append(("importance", len(final), len(final), 0, 0))
    state["trail"] = trail
    return state


def _reduced(df: DataFrame, state: dict) -> DataFrame:
    fitted = state["projection"]
    return df if fitted is None else md.apply_projection(df, {**fitted, "components": np.array(fitted["components"])}, fitted["mode"])


def replay(df: DataFrame, state: dict) -> DataFrame:
    """The features of a fitted run on any table: the columns of ``keep``, the target and ``split`` where the table has
    them, then the features in their fitted order.  A missing source column is an error; other columns are left out."""
    along = [c for c in (*state["keep"], state["target"], "split") if c in df.columns]
    generated = ft.apply_features(enforce_features(df, state["sources"], along), state["plan"])
    return _reduced(generated.select(*along, *state["selected"]), state).select(*along, *state["features"])


def lineage(spark: SparkSession, state: dict) -> DataFrame:
    rows = [(i + 1, *step) for i, step in enumerate(state["trail"])]
    return spark.createDataFrame(rows, "step_order int, step string, cols_before int, cols_after int, n_generated int, n_removed int")


def importance(spark: SparkSession, state: dict) -> DataFrame:
    """One row per feature: the share by each method and the mean rank."""
    methods = ["random_forest", "boosted_trees", "linear_contribution", "mean_rank"]
    rows = [(r["feature"], *[float(r[m]) for m in methods]) for r in state["importance"]]
    return spark.createDataFrame(rows, "feature string, " + ", ".join(f"{m} double" for m in methods))


def run_features(df: DataFrame, target: str, keep: Sequence[str], store: FeatureStore, hints: dict | None = None, settings: Settings | None = None) -> tuple[DataFrame, dict]:
    """Fit on train, replay on every split, store rows and document as a new version; returns the stored rows and record."""
    state = fit_features(df, target, keep, hints, settings)
    record = store.save(replay(df, state), {"target": target, "features": state["features"], "state": state})
    return store.load(record["version"])


def replay_version(df: DataFrame, store: FeatureStore, version: str | None = None) -> DataFrame:
    """What a stored version (the latest, if none is named) makes of another table."""
    return replay(df, store.load(version)[1]["state"])
