"""Isolation forest: trees on small random subsamples, scoring spread over the table.

Trees are grown from at most ``trees * 256`` sampled rows (a fixed bound), so they can be
shipped to every task; scoring is one Arrow-batched pass with no shuffle.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_null
from ..session import bounded_collect, materialize
from .order import quantiles, sample_rows

# Rows per tree and the score above which a row is anomalous by default.
SUBSAMPLE, AUTO_CUT = 256, 0.5
# Rows scored at once: what is computed on the way stays in the cache.
SCORED = 4_096
EULER = 0.5772156649015329


def path_norm(n):
    """Expected path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2.0 * (np.log(big - 1.0) + EULER) - 2.0 * (big - 1.0) / big))


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """One tree as (feature, cut, left, right, leaf length) rows; feature -1 marks a leaf."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list = [None]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(splittable):
            nodes[at] = (-1, 0.0, -1, -1, depth + float(path_norm(len(rows))))
            continue
        f = int(rng.choice(splittable))
        cut = float(min(rng.uniform(lo[f], hi[f]), np.nextafter(hi[f], lo[f])))  # neighbouring numbers: a draw may round up to hi
        left, right = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[at] = (f, cut, left, right, 0.0)
        goes_left = part[:, f] <= cut
        todo += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


def fit_isolation_forest(df: DataFrame, columns: Sequence[str], key: str, trees: int = 100, seed: int = 42) -> dict:
    """Sample, grow one tree per task, bring the bounded node tables back."""
    cols = list(columns)
    medians = {c: (q[0] if q[0] is not None else 0.0) for c, q in quantiles(df.select(*[finite_or_null(c).alias(c) for c in cols]), cols, [0.5]).items()}
    filled = df.select(key, *[F.coalesce(finite_or_null(c), F.lit(medians[c])).alias(c) for c in cols])
    pool = bounded_collect(sample_rows(filled, trees * SUBSAMPLE, key, seed), trees * SUBSAMPLE)
    x = np.array([[r[c] for c in cols] for r in pool], dtype=float)
    size = min(SUBSAMPLE, len(x))

    def build(batches):
        for pdf in batches:
            for tree in pdf["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                nodes = grow(x[rng.choice(len(x), size, replace=False)], rng)
                yield pd.DataFrame(
                    [(int(tree), i, *n) for i, n in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "left", "right", "length"]
                )

    spark = df.sparkSession
    tasks = min(trees, spark.sparkContext.defaultParallelism)
    table = spark.range(0, trees, 1, tasks).mapInPandas(
        build, "tree int, node int, feature int, cut double, left int, right int, length double"
    )
    forest: list = [[] for _ in range(trees)]
    for r in bounded_collect(table, trees * 2 * SUBSAMPLE):
        forest[r["tree"]].append(r)
    arrays = []
    for nodes in forest:
        nodes.sort(key=lambda n: n["node"])
        arrays.append(tuple(np.array([n[c] for n in nodes]) for c in ("feature", "cut", "left", "right", "length")))
    return {"columns": cols, "medians": medians, "size": size, "trees": arrays}


def laid_out(tree: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree as a full one: feature and cut per inner node, level by level, and the length of each of its last leaves.
    A leaf above the last level goes on to its left child, past infinite cuts."""
    feature, cut, left, right, length = tree
    depth, level = 0, np.array([0])
    features, cuts = [], []
    while (feature[level] >= 0).any():
        inner = feature[level] >= 0
        features.append(np.where(inner, feature[level], 0))
        cuts.append(np.where(inner, cut[level], np.inf))
        level = np.stack([np.where(inner, left[level], level), np.where(inner, right[level], level)], axis=1).ravel()
        depth += 1
    empty = np.zeros(0, int)
    return np.concatenate([empty, *features]).astype(np.int64), np.concatenate([np.zeros(0), *cuts]), length[level]


def path_lengths(m: np.ndarray, trees: Sequence[tuple]) -> np.ndarray:
    """Sum over the trees of each row's path; ``trees`` as ``laid_out`` gives them."""
    total = np.zeros(len(m))
    for begin in range(0, len(m), SCORED):
        columns = np.ascontiguousarray(m[begin : begin + SCORED].T)
        n = columns.shape[1]
        flat, row = columns.ravel(), np.arange(n)
        out = total[begin : begin + n]
        for feature, cut, length in trees:
            at, shift = np.zeros(n, np.int64), feature * n
            first, inner = 0, len(cut)
            while first < inner:  # nodes of a level are first ... 2 * first
                width = first + 1
                if width == 1:
                    at = (columns[feature[0]] > cut[0]).astype(np.int64)
                elif width == 2:
                    at += at + np.where(at, columns[feature[2]] > cut[2], columns[feature[1]] > cut[1])
                else:
                    where = at + first
                    value = flat.take(shift.take(where, mode="clip") + row, mode="clip")
                    at += at
                    at += value > cut.take(where, mode="clip")
                first = 2 * first + 1
            out += length.take(at, mode="clip")
    return total


def anomaly_scores(df: DataFrame, forest: dict, out: str = "anomaly_score") -> DataFrame:
    """Score in (0, 1]; higher is more anomalous."""
    cols, norm = forest["columns"], float(path_norm(forest["size"])) or 1.0
    trees = [laid_out(t) for t in forest["trees"]]

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        total = path_lengths(np.column_stack([c.to_numpy(dtype=float) for c in columns]), trees)
        return pd.Series(np.power(2.0, -(total / len(trees)) / norm))

    return df.withColumn(out, score(*[F.coalesce(finite_or_null(c), F.lit(forest["medians"][c])) for c in cols]))


def anomaly_cut(scored: DataFrame, contamination: float | str = "auto", score: str = "anomaly_score") -> float:
    if contamination == "auto":
        return AUTO_CUT
    return quantiles(scored, [score], [1.0 - float(contamination)])[score][0]


def anomaly_summary(df: DataFrame, columns: Sequence[str], key: str, trees: int = 200, contamination: float | str = "auto", seed: int = 42) -> DataFrame:
    """Count, share, lowest and mean score (negated, so lower is more anomalous)."""
    scored = anomaly_scores(df, fit_isolation_forest(df, columns, key, trees, seed)).select("anomaly_score")
    if contamination != "auto":  # read several times
        scored = materialize(scored, "anomaly-scores")
    cut = anomaly_cut(scored, contamination)
    hit = F.col("anomaly_score") > cut
    return scored.agg(
        F.count("*").alias("n_rows"), F.count_if(hit).alias("n_anomalies"), (F.count_if(hit) * 100.0 / F.count("*")).alias("anomaly_pct"),
        F.min(-F.col("anomaly_score")).alias("min_score"), F.avg(-F.col("anomaly_score")).alias("mean_score"),
    )


def filter_anomalies(df: DataFrame, forest: dict, cut: float, train: str = "train", split: str = "split") -> DataFrame:
    """Drop anomalous rows of the train split; held-out rows always stay."""
    scored = anomaly_scores(df, forest)
    return scored.filter((F.col(split) != train) | (F.col("anomaly_score") <= cut)).drop("anomaly_score")
