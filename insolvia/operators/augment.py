"""Random views of feature arrays, and statistics of embedding tables.

All randomness is derived from a hash of (seed, operator, row key, view, position), so a
recomputed partition gives the same view and no state is shared between tasks.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import binned
from ..session import bounded_collect
from .order import hash_uniform, sample_rows

TWO32 = float(1 << 32)
# Fixed value: rows that may exchange values with one another.
BATCH_ROWS = 256


def uniform(name: str, key: Column, view: Column | int, position: Column, seed: int) -> Column:
    """Uniform in (0, 1), half a step away from both ends."""
    view = F.lit(view) if isinstance(view, int) else view
    return (hash_uniform(F.lit(name), key, view, position, seed=seed).cast("double") + 0.5) / F.lit(TWO32)


def normal(name: str, key: Column, view: Column | int, position: Column, seed: int) -> Column:
    """Standard normal draw from two uniforms."""
    u1, u2 = uniform(name + "/r", key, view, position, seed), uniform(name + "/a", key, view, position, seed)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def _each(x: Column, fn) -> Column:
    return F.transform(x.cast("array<double>"), lambda v, i: fn(v, i))


def feature_masking(x: Column, key: Column, view: Column | int = 0, ratio: float = 0.15, seed: int = 42) -> Column:
    return _each(x, lambda v, i: F.when(uniform("mask", key, view, i, seed) >= ratio, v).otherwise(0.0))


def feature_dropout(x: Column, key: Column, view: Column | int = 0, p: float = 0.1, seed: int = 42) -> Column:
    return _each(x, lambda v, i: F.when(uniform("dropout", key, view, i, seed) >= p, v).otherwise(0.0))


def gaussian_noise(x: Column, key: Column, view: Column | int = 0, sigma: float = 0.1, seed: int = 42) -> Column:
    return _each(x, lambda v, i: v + normal("noise", key, view, i, seed) * sigma)


def random_corruption(x: Column, key: Column, view: Column | int = 0, ratio: float = 0.1, scale: float = 1.0, seed: int = 42) -> Column:
    return _each(
        x, lambda v, i: F.when(uniform("corrupt", key, view, i, seed) < ratio, normal("corrupt", key, view, i, seed) * scale).otherwise(v)
    )


def batch_count(df: DataFrame, size: int = BATCH_ROWS) -> int:
    return max(1, math.ceil(df.count() / size))


def with_partner(df: DataFrame, key: str, columns: Sequence[str], seed: int = 42, batch: int = BATCH_ROWS) -> DataFrame:
    """Add ``_partner``: the listed columns of a random row of the same hash batch.

    Two hash orders of a batch are matched by position, which is a random permutation.
    Batches have about ``batch`` rows because keys hash evenly, so windows stay small.
    """
    n = batch_count(df, batch)
    b = F.pmod(hash_uniform(F.lit("batch"), F.col(key), seed=seed), F.lit(n)).alias("_b")
    place = lambda name: F.row_number().over(Window.partitionBy("_b").orderBy(hash_uniform(F.lit(name), F.col(key), seed=seed), key))
    left = df.withColumn("_b", b).withColumn("_i", place("order"))
    right = df.select(key, *columns).withColumn("_b", b).withColumn("_i", place("partner"))
    right = right.select("_b", "_i", F.struct(*columns).alias("_partner"))
    return left.join(right, ["_b", "_i"]).drop("_i")


def column_shuffle(df: DataFrame, key: str, x: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Replace a share of values by the same position of a partner row."""
    paired = with_partner(df, key, [x], seed)
    swapped = F.zip_with(
        F.transform(F.col(x).cast("array<double>"), lambda v, i: F.struct(v.alias("v"), uniform("swap", F.col(key), 0, i, seed).alias("u"))),
        F.col(f"_partner.{x}").cast("array<double>"),
        lambda a, o: F.when(a["u"] < ratio, o).otherwise(a["v"]),
    )
    return paired.withColumn(x, swapped).drop("_partner", "_b")


@F.pandas_udf(T.DoubleType())
def _beta_draw(seed: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([max(0.5, float(np.random.default_rng(int(s)).beta(a, a))) for s, a in zip(seed, alpha)])


def mixup(df: DataFrame, key: str, x: str, alpha: float = 0.2, seed: int = 42) -> DataFrame:
    """lam * x + (1 - lam) * partner with one Beta draw per batch, kept in [0.5, 1]."""
    paired = with_partner(df, key, [x], seed)
    draws = paired.select("_b").distinct().withColumn("lam", _beta_draw(hash_uniform(F.lit("mixup"), F.col("_b"), seed=seed), F.lit(float(alpha))))
    joined = paired.join(draws, "_b")
    mixed = F.zip_with(
        F.col(x).cast("array<double>"), F.col(f"_partner.{x}").cast("array<double>"), lambda a, o: F.col("lam") * a + (1 - F.col("lam")) * o
    )
    return joined.withColumn(x, mixed).drop("_partner", "_b")


AUGMENTATIONS = {
    "feature_masking": feature_masking,
    "feature_dropout": feature_dropout,
    "gaussian_noise": gaussian_noise,
    "random_corruption": random_corruption,
}


def views(df: DataFrame, key: str, x: str, steps: Sequence[dict] | None = None, n_views: int = 2, seed: int = 42) -> DataFrame:
    """Independent augmented views per row: (key, view, x), the steps composed in order."""
    steps = steps or [{"name": "feature_masking", "ratio": 0.15}, {"name": "gaussian_noise", "sigma": 0.1}]
    spread = df.withColumn("view", F.explode(F.array(*[F.lit(i) for i in range(n_views)])))
    out = F.col(x)
    for step in steps:
        params = {k: v for k, v in step.items() if k != "name"}
        if step["name"] not in AUGMENTATIONS:
            raise ValueError(f"unknown augmentation {step['name']}")
        out = AUGMENTATIONS[step["name"]](out, F.col(key), F.col("view"), seed=seed, **params)
    return spread.withColumn(x, out)


# ---------------------------------------------------------------- embedding statistics
def l2_norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


def embedding_statistics(df: DataFrame, x: str) -> DataFrame:
    """Size, spread and norms.  Rows with a NaN or infinite value make the call fail."""
    bad = F.exists(F.col(x), lambda v: F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull())
    per_row = df.select(F.col(x).cast("array<double>").alias("x"), l2_norm(F.col(x)).alias("norm"), bad.alias("bad")).select(
        "norm", "bad", F.size("x").alias("d"), F.array_min("x").alias("lo"), F.array_max("x").alias("hi"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("s"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("ss"),
    )
    mean = F.sum("s") / F.sum("d")
    out = per_row.agg(
        F.count("*").alias("n_samples"), F.max("d").alias("dim"), mean.alias("mean"),
        F.sqrt(F.greatest(F.sum("ss") / F.sum("d") - mean * mean, F.lit(0.0))).alias("std"),
        F.min("lo").alias("min"), F.max("hi").alias("max"), F.avg("norm").alias("mean_l2_norm"), F.stddev_pop("norm").alias("std_l2_norm"),
        F.count_if("bad").alias("bad"),
    )
    row = out.first()
    if row["bad"]:
        raise ValueError("embeddings contain non-finite values")
    return df.sparkSession.createDataFrame([row], out.schema).drop("bad")


def similarity_matrix(df: DataFrame, key: str, label: str, x: str, n: int = 200, seed: int = 42) -> DataFrame:
    """Cosine similarities of a reproducible sample of ``n`` rows in label order.

    The sample is the operator's parameter, so one copy of it can go to every task.
    """
    sample = sample_rows(df.select(key, label, x), n, key, seed)
    rows = bounded_collect(sample.orderBy(label, key), max(n, 1))
    ids = [r[key] for r in rows]
    z = np.array([r[x] for r in rows], dtype="float64")
    z = z / np.clip(np.linalg.norm(z, axis=1, keepdims=True), 1e-12, None)

    def compare(batches):
        for pdf in batches:
            q = np.array(pdf[x].tolist(), dtype="float64")
            q = q / np.clip(np.linalg.norm(q, axis=1, keepdims=True), 1e-12, None)
            sims = q @ z.T
            yield pd.DataFrame(
                {"id_a": np.repeat(pdf[key].to_numpy(), len(ids)), "id_b": np.tile(ids, len(q)), "similarity": sims.ravel()}
            )

    return sample.select(key, x).mapInPandas(compare, "id_a bigint, id_b bigint, similarity double")


def embedding_histogram(df: DataFrame, x: str, value_bins: int = 60, norm_bins: int = 40) -> DataFrame:
    """Equal-width counts of all values and of the row norms: (kind, bin, n)."""
    frame = df.select(F.col(x).cast("array<double>").alias("x"), l2_norm(F.col(x)).alias("norm"))
    e = frame.agg(
        F.min(F.array_min("x")).alias("vlo"), F.max(F.array_max("x")).alias("vhi"), F.min("norm").alias("nlo"), F.max("norm").alias("nhi")
    ).first()
    values = frame.select(F.explode("x").alias("v")).select(F.lit("value").alias("kind"), binned(F.col("v"), F.lit(e["vlo"]), F.lit(e["vhi"]), value_bins).alias("bin"))
    norms = frame.select(F.lit("norm").alias("kind"), binned(F.col("norm"), F.lit(e["nlo"]), F.lit(e["nhi"]), norm_bins).alias("bin"))
    return values.unionByName(norms).groupBy("kind", "bin").agg(F.count("*").alias("n"))
