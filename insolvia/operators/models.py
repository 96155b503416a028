"""Classifiers, mostly on Spark ML, tuning, cross-validation, importances and projections.

Forests and boosted trees are grown by operators/trees.py.  Stand-ins where Spark has no equal: gradient-boosted trees for the boosting back-ends, a
random forest for extremely randomised trees, a sigmoid network for the rectified one.
The kernel machine is a linear margin over random Fourier features of the Gaussian kernel,
with a fitted logistic link.  Gaussian naive Bayes is one aggregate and a projection.
"""
from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as mlc
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import melt
from ..session import bounded_collect, materialize, shared_folder
from ..store import files
from . import metrics as mt
from . import trees as tr
from .augment import with_partner
from .neighbors import nearest, vote_share
from .prepare import apply_scale, enforce_features, fit_scale
from .relations import correlation_matrix, rank_auc
from .scoring import linear_contributions
from .wide import array_width, feature_numbers, per_feature

# Default parameters per algorithm.
DEFAULTS: dict[str, dict] = {
    "logistic_regression": {"C": 1.0, "maxIter": 2000},
    "decision_tree": {"maxDepth": 8, "minInstancesPerNode": 5},
    "random_forest": {"numTrees": 400, "maxDepth": 15, "minInstancesPerNode": 2},
    "boosted_trees": {"maxIter": 600, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.9},
    "naive_bayes": {"var_smoothing": 1e-9},
    "mlp": {"hidden": (64, 32), "maxIter": 500},
    "svm": {"C": 1.0, "maxIter": 200, "gamma": "scale", "kernel_features": 256},
    "knn": {"k": 15, "weights": "distance"},
}

# Default search spaces.  The network's penalty has no equal in Spark.
SEARCH_SPACES: dict[str, dict[str, list]] = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0]},
    "decision_tree": {"maxDepth": [4, 6, 8, 12], "minInstancesPerNode": [2, 5, 10]},
    "random_forest": {"numTrees": [200, 400], "maxDepth": [10, 15, 20], "minInstancesPerNode": [1, 2, 5]},
    "boosted_trees": {"maxIter": [300, 600], "maxDepth": [4, 6, 8], "stepSize": [0.03, 0.05, 0.1]},
    "svm": {"C": [0.1, 1.0, 10.0], "gamma": ["scale", 0.01, 0.1]},
    "knn": {"k": [5, 11, 15, 25], "weights": ["uniform", "distance"]},
    "naive_bayes": {"var_smoothing": [1e-11, 1e-9, 1e-7]},
    "mlp": {"hidden": [(32,), (64, 32), (128, 64)]},
}

# Memory a tree fit of Spark ML may use for the node statistics of one pass, and rows a fitting task should have.
TREE_MEMORY_MB = 256
ROWS_PER_TASK = 2_000
# Part of the key under which a fit is kept: raise it when a fit's result changes.
FIT_VERSION = 2


@dataclass
class Fitted:
    name: str
    features: list[str]
    model: PipelineModel | None = None
    params: dict = field(default_factory=dict)
    link: tuple[float, float] | None = None  # logistic link of a margin classifier
    reference: DataFrame | None = None  # training rows of the neighbour classifier
    target: str = "target"
    numbers: dict = field(default_factory=dict)  # class moments of naive Bayes, kernel map of the margin classifier, where grown trees are and what they tell


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="error")


def class_counts(df: DataFrame, target: str) -> dict:
    return {r[target]: r["count"] for r in bounded_collect(df.groupBy(target).count(), 100)}


def class_weights(counts: dict, scheme: str = "balanced") -> tuple[float, float]:
    """Weights of the classes 0 and 1: balanced, or negative/positive on the positives only."""
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    total = pos + neg
    if scheme == "balanced":
        return total / (2.0 * max(neg, 1)), total / (2.0 * max(pos, 1))
    return 1.0, neg / max(pos, 1)


def with_class_weight(df: DataFrame, target: str, scheme: str = "balanced") -> DataFrame:
    """Row weight ``_w`` of the row's class."""
    on_neg, on_pos = class_weights(class_counts(df, target), scheme)
    return df.withColumn("_w", F.when(F.col(target) == 1, on_pos).otherwise(on_neg))


def estimator(name: str, features: Sequence[str], target: str, params: dict, rows: int, seed: int = 42):
    common = {"featuresCol": "_x", "labelCol": target}
    p = {**DEFAULTS[name], **params}
    if name == "logistic_regression":
        # the penalty is summed over rows in the C convention, averaged in Spark's
        reg = p.get("regParam", 1.0 / (p["C"] * max(rows, 1)))
        return mlc.LogisticRegression(**common, weightCol="_w", regParam=reg, maxIter=p["maxIter"], standardization=False)
    if name == "decision_tree":
        return mlc.DecisionTreeClassifier(**common, weightCol="_w", seed=seed, maxMemoryInMB=TREE_MEMORY_MB, **p)
    if name == "random_forest":
        return mlc.RandomForestClassifier(**common, weightCol="_w", seed=seed, maxMemoryInMB=TREE_MEMORY_MB, cacheNodeIds=True, **p)
    if name == "boosted_trees":
        return mlc.GBTClassifier(**common, weightCol="_w", seed=seed, maxMemoryInMB=TREE_MEMORY_MB, **p)
    if name == "mlp":
        return mlc.MultilayerPerceptronClassifier(**common, layers=[len(features), *p["hidden"], 2], maxIter=p["maxIter"], seed=seed)
    if name == "svm":
        return mlc.LinearSVC(**common, weightCol="_w", regParam=1.0 / (p["C"] * max(rows, 1)), maxIter=p["maxIter"])
    raise ValueError(f"unknown algorithm {name}")


# ---------------------------------------------------------------- Gaussian naive Bayes
def fit_class_moments(train: DataFrame, features: Sequence[str], target: str, smoothing: float) -> dict:
    """Log prior, means and smoothed variances of the classes 0 and 1: a row per class and feature leaves the executors."""
    moments = {(int(r[target]), r["feature"]): (r["m"], r["v"]) for r in per_feature(train, features, {"m": F.avg, "v": F.var_pop}, by=[target]).collect() if r[target] is not None}
    counts = {r[target]: r["count"] for r in bounded_collect(train.groupBy(target).count(), 100)}
    total = sum(counts.get(k, 0) for k in (0, 1))
    widest = max((v["v"] or 0.0 for v in feature_numbers(train, features, {"v": F.var_pop}).values()), default=0.0)
    out = {"prior": [math.log(counts[k] / total) if counts.get(k) else -math.inf for k in (0, 1)], "mean": {}, "variance": {}}
    for c in features:
        pairs = [moments.get((k, c), (0.0, 0.0)) for k in (0, 1)]
        out["mean"][c] = [float(m or 0.0) for m, _ in pairs]
        out["variance"][c] = [float(v or 0.0) + smoothing * widest or 1e-300 for _, v in pairs]
    return out


def class_probability(moments: dict) -> Column:
    """Probability of class 1 as a projection."""
    def density(k: int) -> Column:
        total = F.lit(moments["prior"][k])
        for c, means in moments["mean"].items():
            v = moments["variance"][c][k]
            total = total - F.lit(0.5 * math.log(2 * math.pi * v)) - (F.col(f"`{c}`") - F.lit(means[k])) ** 2 / F.lit(2 * v)
        return total

    return 1.0 / (1.0 + F.exp(density(0) - density(1)))


# ---------------------------------------------------------------- kernel map
def fit_kernel(train: DataFrame, features: Sequence[str], gamma: str | float, count: int, seed: int) -> dict:
    """Width of the Gaussian kernel ("scale": one over the number of features times the variance of all entries) and the size of its map."""
    if gamma == "scale":
        sums = feature_numbers(train, features, {"m": F.avg, "q": lambda x: F.avg(x * x)}).values()
        mean, square = (float(np.mean([v[k] or 0.0 for v in sums])) for k in ("m", "q"))
        gamma = 1.0 / (len(features) * max(square - mean * mean, 1e-12))
    return {"gamma": float(gamma), "count": int(count), "seed": int(seed)}


def with_kernel_map(df: DataFrame, features: Sequence[str], kernel: dict) -> DataFrame:
    """``_x``: random Fourier features, whose inner products approach exp(-gamma * distance^2)."""
    rng = np.random.default_rng(kernel["seed"])
    directions = rng.normal(0.0, math.sqrt(2 * kernel["gamma"]), (len(features), kernel["count"]))
    phases = rng.uniform(0, 2 * math.pi, kernel["count"])

    @F.pandas_udf("array<double>")
    def mapped(rows: pd.Series) -> pd.Series:
        x = np.array(rows.tolist(), float).reshape(len(rows), len(directions))
        return pd.Series(list(math.sqrt(2 / len(phases)) * np.cos(x @ directions + phases)))

    return df.withColumn("_x", array_to_vector(mapped(F.array(*[F.col(f"`{c}`").cast("double") for c in features]))))


# ---------------------------------------------------------------- fit and predict
def fit(name: str, train: DataFrame, features: Sequence[str], target: str = "target", params: dict | None = None, seed: int = 42) -> Fitted:
    features, params = list(features), dict(params or {})
    if name not in DEFAULTS:
        raise ValueError(f"unknown algorithm {name}")
    out = Fitted(name, features, params={**DEFAULTS[name], **params}, target=target)
    if name == "knn":
        out.reference = train
        return out
    if name == "naive_bayes":
        out.numbers = fit_class_moments(train, features, target, out.params["var_smoothing"])
        return out
    scheme = "positive" if name == "boosted_trees" else "balanced"
    if name in tr.KNOWN and tr.growable(name, counts := class_counts(train, target), features, out.params):
        grow = tr.fit_boosted if name == "boosted_trees" else tr.fit_forest
        out.numbers = grow(train, features, target, counts, class_weights(counts, scheme), out.params, seed)
        return out
    rows = train.count()
    weighted = with_class_weight(train, target, scheme)
    stages = [assembler(features), estimator(name, features, target, params, rows, seed)]
    if name == "svm":
        out.numbers = fit_kernel(train, features, out.params["gamma"], out.params["kernel_features"], seed)
        weighted, stages = materialize(with_kernel_map(weighted.select(*features, target, "_w"), features, out.numbers).select("_x", target, "_w"), "kernel-map"), stages[1:]
    out.model = Pipeline(stages=stages).fit(weighted)
    if name == "svm":
        margins = out.model.transform(weighted).select(target, vector_to_array("rawPrediction")[1].alias("margin"))
        link = Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="_m"), mlc.LogisticRegression(featuresCol="_m", labelCol=target)])
        lr = link.fit(margins).stages[-1]
        out.link = (float(lr.coefficients[0]), float(lr.intercept))
    return out


def neighbours(fitted: Fitted, df: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """The nearest training rows of every row, as many as the fit asks for or ``k``."""
    vec = F.array(*[F.col(c).cast("double") for c in fitted.features])
    queries = df.select(F.col(key).alias("id"), vec.alias("vec"))
    refs = fitted.reference.select(F.col(key).alias("id"), vec.alias("vec"), F.col(fitted.target).cast("double").alias("payload"))
    return nearest(queries, refs, k or fitted.params["k"])


def by_votes(fitted: Fitted, df: DataFrame, near: DataFrame, out: str, key: str) -> DataFrame:
    """The rows with the vote of their first k of the neighbours found."""
    votes = vote_share(near.filter(F.col("rank") <= fitted.params["k"]), fitted.params["weights"])
    return df.join(votes.select(F.col("id").alias(key), F.col("p").alias(out)), key)


def predict(fitted: Fitted, df: DataFrame, out: str = "p", key: str = "entity_id") -> DataFrame:
    """Add the positive-class probability; missing model columns are an error."""
    enforce_features(df, fitted.features)
    if fitted.name == "knn":
        return by_votes(fitted, df, neighbours(fitted, df, key), out, key)
    if fitted.name == "naive_bayes":
        return df.withColumn(out, class_probability(fitted.numbers))
    if "trees" in fitted.numbers:
        return df.withColumn(out, tr.probability(df, fitted.features, fitted.numbers))
    scored = fitted.model.transform(with_kernel_map(df, fitted.features, fitted.numbers) if fitted.name == "svm" else df)
    if fitted.link:
        a, b = fitted.link
        p = 1.0 / (1.0 + F.exp(-(a * vector_to_array("rawPrediction")[1] + b)))
    else:
        p = vector_to_array("probability")[1]
    return scored.select(*df.columns, p.alias(out))


# ---------------------------------------------------------------- kept fits
def save_fitted(fitted: Fitted, path: str, spark: SparkSession) -> str:
    """All a fit needs to score again under one folder; ``fitted.json`` comes last and tells that it is complete."""
    if fitted.model is not None:
        fitted.model.write().overwrite().save(f"{path}/model")
    if fitted.reference is not None:
        fitted.reference.write.mode("overwrite").parquet(f"{path}/reference")
    if "trees" in fitted.numbers:
        files.copy(spark, fitted.numbers["trees"], f"{path}/trees")
    plain = {"name": fitted.name, "features": fitted.features, "params": fitted.params, "link": fitted.link, "target": fitted.target, "numbers": fitted.numbers,
             "has_model": fitted.model is not None, "has_reference": fitted.reference is not None}
    files.write_json(spark, f"{path}/fitted.json", plain)
    return path


def load_fitted(spark: SparkSession, path: str) -> Fitted | None:
    """The fit kept under the folder; nothing where none is complete."""
    plain = files.read_json(spark, f"{path}/fitted.json")
    if plain is None:
        return None
    model = PipelineModel.load(f"{path}/model") if plain["has_model"] else None
    reference = spark.read.parquet(f"{path}/reference") if plain["has_reference"] else None
    if "trees" in plain["numbers"]:
        plain["numbers"]["trees"] = f"{path}/trees"
    return Fitted(plain["name"], plain["features"], model, plain["params"], tuple(plain["link"]) if plain["link"] else None, reference, plain["target"], plain["numbers"])


def fingerprint(df: DataFrame, columns: Sequence[str], *settings) -> str:
    """Digest of the rows (in any order) and of the settings."""
    cells = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(json.dumps([list(columns), row["n"], str(row["s"]), FIT_VERSION, settings], default=str, sort_keys=True).encode()).hexdigest()[:24]


def compact(df: DataFrame, rows: int) -> DataFrame:
    """A stored table in as many partitions as its rows need: fits run hundreds of small jobs over it."""
    return df.coalesce(max(1, math.ceil(rows / ROWS_PER_TASK)))


def fit_once(name: str, train: DataFrame, features: Sequence[str], target: str = "target", params: dict | None = None, seed: int = 42, key: str = "entity_id", folder: str | None = None) -> Fitted:
    """``fit``, kept under the shared folder: the same rows, columns and settings are fitted once, in this run or after a restart."""
    spark = train.sparkSession
    columns = [*features, target, *([key] if key in train.columns and key not in features else [])]
    mark = fingerprint(train, columns, name, {**DEFAULTS[name], **(params or {})}, seed)
    path = f"{folder or shared_folder(spark) + '/fits'}/{name}-{mark}"
    kept = load_fitted(spark, path)
    if kept is None:
        stored = materialize(train.select(*columns), f"train-{name}")
        save_fitted(fit(name, compact(stored, stored.count()), features, target, params, seed), path, spark)
        kept = load_fitted(spark, path)
    return kept


def in_pool(spark: SparkSession, jobs: Sequence[Callable[[], object]], workers: int) -> list:
    """Results of the jobs in their order, at most ``workers`` at a time, each in a scheduler pool of its own so that short
    ones are not held up by long ones (with spark.scheduler.mode=FAIR)."""

    def run(at: int):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{at}")
        return jobs[at]()

    with ThreadPoolExecutor(max(1, workers)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), i) for i in range(len(jobs))]]


# ---------------------------------------------------------------- tuning
def search_grid(name: str, space: dict[str, list] | None = None, method: str = "grid", n_iter: int = 15, seed: int = 42) -> list[dict]:
    space = space or SEARCH_SPACES[name]
    grid = [dict(zip(space, values)) for values in itertools.product(*space.values())]
    if method == "random" and len(grid) > n_iter:
        return random.Random(seed).sample(grid, n_iter)
    return grid


def fold_parts(values: Sequence[int], kind: str) -> list[tuple[list[int], int]]:
    """(blocks to train on, block to test on) per fold.  ``shuffled``: all others train.  ``time``: the first block only
    trains, every later one is tested on by what came before it."""
    ordered = sorted(values)
    if kind == "shuffled":
        return [([o for o in ordered if o != v], v) for v in ordered]
    if kind == "time":
        return [(ordered[:i], v) for i, v in enumerate(ordered) if i]
    raise ValueError(f"unknown kind of folds {kind}")


def cross_validate(
    name: str, train: DataFrame, features: Sequence[str], target: str, fold: str, candidates: Sequence[dict] = ({},), parallelism: int = 4, seed: int = 42,
    kind: str = "shuffled", key: str = "entity_id",
) -> list[dict]:
    """Mean and deviation of ROC-AUC over the folds for each candidate, best first; any algorithm, candidates and folds
    side by side.  A fold whose training or test part lacks a class has no score and is left out.  Candidates of the
    neighbour classifier share each fold's search: the k nearest are the first k of the most any of them asks for."""
    spark = train.sparkSession
    keys = [key] if key in train.columns and key not in features else []
    stored = materialize(train.select(*keys, *features, target, F.col(fold).cast("int").alias("_fold")), "folds")
    sizes = {}
    for r in bounded_collect(stored.groupBy("_fold", target).count(), 10_000):
        sizes.setdefault(r["_fold"], {})[r[target]] = r["count"]
    rows = sum(n for c in sizes.values() for n in c.values())
    stored = compact(stored, rows)
    both = lambda blocks: all(any(sizes[b].get(k) for b in blocks) for k in (0, 1))
    parts = [(some, one) for some, one in fold_parts([v for v in sizes if v is not None], kind) if some and both(some) and both([one])]

    def searched(some: list[int], one: int) -> DataFrame:
        fitted = fit(name, stored.where(F.col("_fold").isin(some)), features, target, {}, seed)
        most = max({**DEFAULTS[name], **c}["k"] for c in candidates)
        return materialize(neighbours(fitted, stored.where(F.col("_fold") == one), key, most), "fold-neighbours")

    shared = dict(zip([one for _, one in parts], in_pool(spark, [lambda some=some, one=one: searched(some, one) for some, one in parts], parallelism))) if name == "knn" else {}

    def score(candidate: dict, some: list[int], one: int) -> float:
        fitted, tested = fit(name, stored.where(F.col("_fold").isin(some)), features, target, candidate, seed), stored.where(F.col("_fold") == one)
        scored = by_votes(fitted, tested, shared[one], "p", key) if one in shared else predict(fitted, tested, key=key)
        return mt.roc_auc(mt.score_counts(scored, target, "p")).first()["roc_auc"]

    jobs = [lambda c=c, some=some, one=one: score(c, some, one) for c in candidates for some, one in parts]
    found = in_pool(spark, jobs, parallelism)
    out = []
    for i, c in enumerate(candidates):
        scores = [float(v) for v in found[i * len(parts) : (i + 1) * len(parts)]]
        out.append({"params": dict(c), "mean": float(np.mean(scores)) if scores else float("nan"), "std": float(np.std(scores)) if scores else float("nan"), "scores": scores})
    return sorted(out, key=lambda r: -r["mean"])


# ---------------------------------------------------------------- importances
def native_importance(fitted: Fitted) -> dict[str, float]:
    """Tree importances or absolute coefficients; empty for models that have neither."""
    if fitted.name == "svm":  # its coefficients belong to the kernel map, not to features
        return {}
    if "trees" in fitted.numbers:
        return dict(zip(fitted.features, fitted.numbers["importance"]))
    model = fitted.model.stages[-1] if fitted.model is not None else None
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        values = np.abs(model.coefficients.toArray())
    else:
        return {}
    return {c: float(v) for c, v in zip(fitted.features, values)}


def importance_table(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in values.items()], "feature string, importance double")


def permutation_importance(fitted: Fitted, df: DataFrame, target: str, key: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Loss of ROC-AUC when one feature is exchanged between rows: mean and deviation.

    All features of a repeat are scored in one pass over (row, permuted feature) and
    their AUCs come from one grouped sweep.
    """
    features = fitted.features
    auc = lambda frame, by: rank_auc(mt.score_counts(frame, target, "p", by), by, value="p")
    base = auc(predict(fitted, df, key=key), []).first()["auc"]
    drops = None
    for rep in range(repeats):
        paired = with_partner(df.select(key, target, *features), key, features, seed + rep)
        spread = paired.withColumn("permuted", F.explode(F.array(*[F.lit(c) for c in features])))
        for c in features:
            spread = spread.withColumn(c, F.when(F.col("permuted") == c, F.col(f"_partner.{c}")).otherwise(F.col(c)))
        scored = predict(fitted, spread.select(key, target, "permuted", *features), key=key)
        part = auc(scored, ["permuted"]).select(F.col("permuted").alias("feature"), (F.lit(base) - F.col("auc")).alias("drop"))
        drops = part if drops is None else drops.unionByName(part)
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"))


def combined_importance(train: DataFrame, features: Sequence[str], target: str, trees: int = 300, seed: int = 42) -> DataFrame:
    """Forest, boosted-tree and linear-contribution importances, each summing to 1, with
    the mean rank over the three."""
    ensembles = [("random_forest", {"numTrees": trees}), ("boosted_trees", {"maxIter": trees}), ("logistic_regression", None)]
    fits = in_pool(train.sparkSession, [lambda name=name, params=params: fit(name, train, features, target, params, seed) for name, params in ensembles], len(ensembles))
    forest, boosted = native_importance(fits[0]), native_importance(fits[1])
    linear = fits[2].model.stages[-1].coefficients.toArray()
    contributions = {r["feature"]: r["mean_abs_contribution"] for r in linear_contributions(train, dict(zip(features, linear))).collect()}
    methods = {"random_forest": forest, "boosted_trees": boosted, "linear_contribution": contributions}
    share = {m: {c: v[c] / (sum(v.values()) or 1.0) for c in features} for m, v in methods.items()}
    wide = train.sparkSession.createDataFrame(
        [(c, *[float(share[m][c]) for m in methods]) for c in features], "feature string, " + ", ".join(f"{m} double" for m in methods)
    )
    return wide.join(mean_rank(wide, list(methods)), "feature")


def mean_rank(wide: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Average over methods of the descending rank, ties sharing their mean rank.  One row
    per feature and method, so a plain window is enough."""
    long = melt(wide, methods, keep=["feature"], name="method", value="score")
    w = Window.partitionBy("method").orderBy(F.desc("score"))
    tied = Window.partitionBy("method", "score")
    ranked = long.withColumn("rank", F.rank().over(w) + (F.count("*").over(tied) - 1) / 2.0)
    return ranked.groupBy("feature").agg(F.avg("rank").alias("mean_rank"))


def recursive_elimination(train: DataFrame, features: Sequence[str], target: str, keep: int = 30, step: float = 0.1) -> list[str]:
    """Drop the smallest |coefficient| share per round until ``keep`` features remain."""
    left = list(features)
    drop = max(1, int(step * len(left)))
    while len(left) > keep:
        weight = native_importance(fit("logistic_regression", train, left, target))
        out = sorted(left, key=lambda c: weight[c])[: min(drop, len(left) - keep)]
        left = [c for c in left if c not in out]
    return left


def select_by_forest(train: DataFrame, features: Sequence[str], target: str, trees: int = 200, seed: int = 42) -> list[str]:
    """Features whose forest importance reaches the median; all when fewer than two do."""
    imp = native_importance(fit("random_forest", train, features, target, {"numTrees": trees}, seed))
    cut = float(np.median(list(imp.values())))
    kept = [c for c in features if imp[c] >= cut]
    return kept if len(kept) >= 2 else list(features)


# ---------------------------------------------------------------- projections
def fit_pca(df: DataFrame, columns: Sequence[str], k: int | None = None, variance: float | None = 0.95) -> dict:
    """Centred principal components; ``k`` fixed or as many as exceed ``variance``."""
    cols = list(columns)
    model = PCA(k=len(cols), inputCol="_x", outputCol="_z").fit(assembler(cols).transform(df.select(*cols)))
    ratio = model.explainedVariance.toArray()
    if k is None:
        k = len(cols) if variance is None else min(int(np.searchsorted(np.cumsum(ratio), variance, side="right")) + 1, len(cols))
    means = feature_numbers(df, cols, {"m": F.avg})
    return {"kind": "pca", "columns": cols, "components": model.pc.toArray()[:, :k], "ratio": ratio, "shift": [means[c]["m"] for c in cols]}


def second_moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, column means and covariance (population); only k x k values leave the executors."""
    cols = list(columns)
    stats = feature_numbers(df, cols, {"m": F.avg, "s": F.stddev_pop})
    mean, dev = (np.array([stats[c][k] for c in cols]) for k in ("m", "s"))
    r = np.nan_to_num(correlation_matrix(df, cols), nan=0.0)
    return df.count(), mean, r * np.outer(dev, dev)


def fit_svd(df: DataFrame, columns: Sequence[str], k: int | None = None, variance: float = 0.95) -> dict:
    """Uncentred projection on the right singular vectors, cut at cumulative variance."""
    cols = list(columns)
    n, mean, cov = second_moments(df, cols)
    values, vectors = np.linalg.eigh((cov + np.outer(mean, mean)) * n)
    vectors = vectors[:, np.argsort(values)[::-1]][:, : max(1, min(len(cols), n) - 1)]
    ratio = np.array([v @ cov @ v for v in vectors.T]) / (np.trace(cov) or 1.0)
    if k is None:
        k = min(int(np.searchsorted(np.cumsum(ratio), variance)) + 1, vectors.shape[1])
    return {"kind": "svd", "columns": cols, "components": vectors[:, :k], "ratio": ratio, "shift": [0.0] * len(cols)}


def apply_projection(df: DataFrame, fitted: dict, mode: str = "append") -> DataFrame:
    """Component scores as plain linear expressions: no vector columns, no shuffle."""
    w = fitted["components"]
    scores = {}
    for j in range(w.shape[1]):
        expr = F.lit(0.0)
        for i, c in enumerate(fitted["columns"]):
            expr = expr + (F.col(c) - F.lit(float(fitted["shift"][i]))) * F.lit(float(w[i, j]))
        scores[f"{fitted['kind']}__{j + 1}"] = expr
    out = df.withColumns(scores)
    return out.drop(*fitted["columns"]) if mode == "replace" else out


def explained_variance(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict]:
    """Variance table of the standardised columns and the component counts for 80-99 %."""
    cols = list(columns)
    scaled = apply_scale(df.select(*cols), fit_scale(df, cols))
    ratio = fit_pca(scaled, cols, variance=None)["ratio"]
    cum = np.cumsum(ratio)
    table = df.sparkSession.createDataFrame(
        [(f"PC{i + 1}", float(a), float(b)) for i, (a, b) in enumerate(zip(ratio, cum))],
        "component string, explained_variance_ratio double, cumulative_variance double",
    )
    need = {f"n_components_{int(t * 100)}pct": min(int(np.searchsorted(cum, t)) + 1, len(cols)) for t in (0.80, 0.90, 0.95, 0.99)}
    need["redundancy_index"] = round(1 - need["n_components_95pct"] / len(cols), 4)
    return table, need


def standardised_projection(df: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """First ``k`` principal scores of the standardised columns on every row."""
    cols = list(columns)
    scaled = apply_scale(df, fit_scale(df, cols))
    return apply_projection(scaled, fit_pca(scaled, cols, k=k))


# ---------------------------------------------------------------- training flow
def evaluate_splits(fitted: Fitted, df: DataFrame, target: str, key: str, split: str = "split", method: str = "youden") -> tuple[float, str, dict]:
    """Threshold from val, metrics for val and test at that threshold."""
    scored = predict(fitted, df.filter(F.col(split).isin("val", "test")), key=key).select(key, target, split, "p").persist()
    try:
        t, used = mt.choose_threshold(mt.score_counts(scored.filter(F.col(split) == "val"), target, "p"), method)
        rows = mt.evaluate(scored, t, target, "p", by=[split]).collect()  # one row per split
    finally:
        scored.unpersist()
    return t, used, {r[split]: {k: v for k, v in r.asDict().items() if k != split} for r in rows}


BOARD_METRICS = ("roc_auc", "f1", "recall", "precision", "pr_auc", "accuracy", "balanced_accuracy", "mcc")
# Slow fits start first, so that the pool's last one is a short one.
SLOW_FIRST = ("boosted_trees", "svm", "random_forest", "mlp")


def train_one(
    name: str, df: DataFrame, features: Sequence[str], target: str, key: str, params: dict, split: str = "split", method: str = "youden",
    fold: str | None = None, fold_kind: str = "shuffled", search: str | None = None, n_iter: int = 15, explain: bool = False,
) -> tuple[Fitted, dict]:
    """Tune (when ``search`` names a method), score the folds (when ``fold`` names a column), fit on train, choose the
    threshold on val, evaluate on val and test, explain.  The record holds all of it as plain values."""
    began, train = time.time(), df.filter(F.col(split) == "train")
    record: dict = {"model": name, "error": None, "tuning": None, "cv": None, "importance": None}
    if search and fold:
        best = cross_validate(name, train, features, target, fold, search_grid(name, method=search, n_iter=n_iter), kind=fold_kind, key=key)[0]
        params = {**params, **best["params"]}
        record["tuning"] = {"method": search, "best_params": best["params"], "best_score": best["mean"]}
    if fold:
        scores = cross_validate(name, train, features, target, fold, [params], kind=fold_kind, key=key)[0]
        record["cv"] = {k: scores[k] for k in ("mean", "std", "scores")}
    fitted = fit_once(name, train, features, target, params, key=key)
    record["fit_seconds"] = round(time.time() - began, 3)
    t, used, ev = evaluate_splits(fitted, df, target, key, split, method)
    record.update(params=fitted.params, threshold=float(t), threshold_method=used, metrics=ev)
    if explain:
        native = native_importance(fitted)
        if not native:
            table = permutation_importance(fitted, df.filter(F.col(split) == "val"), target, key)
            native = {r["feature"]: r["importance"] for r in table.collect()}  # one row per feature
        record["importance"] = dict(sorted(native.items(), key=lambda x: (-x[1], x[0])))
    return fitted, record


def train_all(
    df: DataFrame, features: Sequence[str], target: str, key: str, algorithms: dict[str, dict], split: str = "split", method: str = "youden",
    workers: int = 4, folder: str | None = None, **options,
) -> tuple[DataFrame, dict[str, Fitted]]:
    """Leaderboard and models of ``train_run``."""
    board, models, _ = train_run(df, features, target, key, algorithms, split, method, workers, folder, **options)
    return board, models


def train_run(
    df: DataFrame, features: Sequence[str], target: str, key: str, algorithms: dict[str, dict], split: str = "split", method: str = "youden",
    workers: int = 4, folder: str | None = None, **options,
) -> tuple[DataFrame, dict[str, Fitted], list[dict]]:
    """Train every algorithm, several at a time: leaderboard, models and records.  A failing one is
    reported and does not stop the rest.

    Each finished algorithm leaves ``<name>.json`` in the run's folder, named after the rows and
    settings: a run started again goes on with what is missing.  ``options`` are those of ``train_one``.
    """
    spark = df.sparkSession
    fold = [options["fold"]] if options.get("fold") else []
    columns = [key, *features, target, split, *fold]
    run = folder or f"{shared_folder(spark)}/training-{fingerprint(df, columns, method, options)}"
    stored = materialize(df.select(*columns), "training")
    stored = compact(stored, stored.count())

    def one(name: str, params: dict) -> tuple[Fitted | None, dict]:
        settings = json.loads(json.dumps(params, default=str))
        mark = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:8]
        path = f"{run}/{name}-{mark}.json"
        record = files.read_json(spark, path)
        if record is not None:
            return fit_once(name, stored.filter(F.col(split) == "train"), features, target, record["params"], key=key), record
        try:
            fitted, record = train_one(name, stored, features, target, key, params, split, method, **options)
        except Exception as exc:  # isolate one algorithm; it is tried again in the next run
            return None, {"model": name, "error": f"{type(exc).__name__}: {str(exc)[:200]}"}
        files.write_json(spark, path, record)
        return fitted, record

    order = sorted(algorithms, key=lambda n: SLOW_FIRST.index(n) if n in SLOW_FIRST else len(SLOW_FIRST))
    done = dict(zip(order, in_pool(spark, [lambda n=n: one(n, algorithms[n]) for n in order], workers)))
    models = {n: done[n][0] for n in algorithms if done[n][0] is not None}
    rows = []
    for n in algorithms:
        r = done[n][1]
        test = (r.get("metrics") or {}).get("test", {})
        rows.append((n, r.get("threshold"), r.get("threshold_method"), *[None if test.get(m) is None else float(test[m]) for m in BOARD_METRICS], r["error"]))
    schema = "model string, threshold double, threshold_method string, " + ", ".join(f"{m} double" for m in BOARD_METRICS) + ", error string"
    return mt.leaderboard(spark.createDataFrame(rows, schema)), models, [done[n][1] for n in algorithms]


def best_of_two(df: DataFrame, features: Sequence[str], target: str, key: str, forest: dict, boosted: dict) -> DataFrame:
    """Forest against boosted trees on val at 0.5, better average precision first."""
    train, val = (df.filter(F.col("split") == s) for s in ("train", "val"))
    pairs = [("boosted_trees", boosted), ("random_forest", forest)]
    fits = in_pool(df.sparkSession, [lambda n=n, p=p: fit_once(n, train, features, target, p, key=key) for n, p in pairs], 2)
    out = None
    for fitted in fits:
        scored = predict(fitted, val, key=key)
        part = mt.evaluate(scored, 0.5, target, "p").select(F.lit(fitted.name).alias("model"), "roc_auc", "pr_auc", "precision", "recall", "f1")
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("pr_auc"))


def linear_probe(df: DataFrame, x: str, target: str, key: str, split: str = "split") -> tuple[float, dict]:
    """Logistic regression on frozen embeddings."""
    dim = array_width(df, x)
    cols = [f"z_{i:03d}" for i in range(dim)]
    wide = df.select(key, target, split, *[F.col(x)[i].cast("double").alias(c) for i, c in enumerate(cols)])
    fitted = fit("logistic_regression", wide.filter(F.col(split) == "train"), cols, target)
    t, _, ev = evaluate_splits(fitted, wide, target, key, split)
    return t, ev
