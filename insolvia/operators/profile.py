"""Exploratory tables: inventory, target mix, descriptive statistics, shape, outliers, histograms."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import binned, category_of, melt, nan_as_null, numeric_columns, rounded_even
from .order import quantiles
from .quality import iqr_fences, missing_counts
from .wide import feature_numbers, per_feature

# Percentiles of the descriptive table.
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def value_counts(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """(feature, value, n[, pos]) with one row per distinct value, combined map-side."""
    long = melt(df, columns, keep=[label] if label else []).filter(F.col("value").isNotNull())
    aggs = [F.count("*").alias("n")]
    if label:
        aggs.append(F.sum(F.col(label).cast("bigint")).alias("pos"))
    return long.groupBy("feature", "value").agg(*aggs)


def column_inventory(df: DataFrame) -> DataFrame:
    """Type, non-null count and exact distinct count per column."""
    cols = df.columns
    long = nan_as_null(df).select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    distinct = long.filter(F.col("value").isNotNull()).groupBy("feature", "value").count()
    counted = distinct.groupBy("feature").agg(F.sum("count").alias("non_null"), F.count("*").alias("n_unique"))
    types = df.sparkSession.createDataFrame(df.dtypes, "feature string, dtype string")
    return types.join(counted, "feature", "left").select(
        "feature", "dtype", F.coalesce("non_null", F.lit(0)).alias("non_null"), F.coalesce("n_unique", F.lit(0)).alias("n_unique")
    )


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("count"))
    n = df.count()
    return counts.withColumn("percentage", rounded_even(F.col("count") * 100.0 / F.lit(max(n, 1)), 4))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy(target).agg(F.count("*").alias("c"))
    positive = F.sum(F.when(F.col(target) == 1, F.col("c")).otherwise(0))
    return counts.agg(
        F.sum("c").alias("n_samples"),
        F.count(target).alias("n_classes"),
        F.max("c").alias("majority_count"),
        F.min("c").alias("minority_count"),
        rounded_even(F.max("c") / F.greatest(F.min("c"), F.lit(1)), 3).alias("imbalance_ratio"),
        F.when(positive > 0, positive).otherwise(F.min("c")).alias("positive_count"),
    ).select(
        "*",
        (F.col("n_samples") - F.col("positive_count")).alias("negative_count"),
        rounded_even(F.col("positive_count") * 100.0 / F.col("n_samples"), 4).alias("positive_pct"),
        (F.col("imbalance_ratio") >= 5).alias("is_imbalanced"),
    )


def smallest_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, ties to the smallest value."""
    counts = value_counts(df, columns)
    return counts.groupBy("feature").agg(F.max(F.struct("n", (-F.col("value")).alias("neg"))).alias("m")).select(
        "feature", (F.lit(0.0) - F.col("m.neg")).alias("mode")
    )


def shape_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Biased skewness and excess kurtosis; 0 for constants and for two values or fewer."""
    long = per_feature(df, columns, {"n": F.count, "lo": F.min, "hi": F.max, "sk": F.skewness, "ku": F.kurtosis})
    varies = (F.col("n") > 2) & (F.col("lo") < F.col("hi"))
    return long.select(
        "feature",
        F.when(varies, F.col("sk")).otherwise(0.0).alias("skewness"),
        F.when(varies, F.col("ku")).otherwise(0.0).alias("excess_kurtosis"),
    )


def descriptive_statistics(df: DataFrame, columns: Sequence[str], percentiles: Sequence[int] = PERCENTILES) -> DataFrame:
    """Centre, spread, shape and percentiles per column: one moment scan, one mode
    aggregate, exact quantiles."""
    cols = list(columns)
    q = quantiles(df, cols, [0.25, 0.5, 0.75, *[p / 100 for p in percentiles]])
    names = ["q1", "median", "q3", *[f"p{p}" for p in percentiles]]
    quant = df.sparkSession.createDataFrame(
        [(c, *[None if v is None else float(v) for v in q[c]]) for c in cols],
        "feature string, " + ", ".join(f"{n} double" for n in names),
    )
    moments = per_feature(df, cols, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "variance": F.var_samp, "min": F.min, "max": F.max})
    # every side has one row per column of the input, so the joins are broadcast
    return (
        moments.join(F.broadcast(quant), "feature")
        .join(F.broadcast(smallest_mode(df, cols)), "feature", "left")
        .join(F.broadcast(shape_stats(df, cols)), "feature")
        .withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("q3") - F.col("q1"), "kurtosis": F.col("excess_kurtosis")})
        .drop("excess_kurtosis")
    )


def missing_ranking(df: DataFrame) -> DataFrame:
    """Every column with missing values, most first."""
    per = missing_counts(df).filter(F.col("missing") > 0)
    return (
        per.select(F.col("column").alias("feature"), F.col("missing").alias("missing_count"),
                   rounded_even(F.col("missing") * 100.0 / F.col("n"), 4).alias("missing_pct"))
        .orderBy(F.desc("missing_count"), "feature")
    )


def outlier_table(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5, z: float = 3.0) -> DataFrame:
    """Fence and z-score counts per column over all rows (sample deviation, |z| >= limit)."""
    cols = list(columns)
    fences = iqr_fences(df, cols, multiplier)
    stats = feature_numbers(df, cols, {"m": F.avg, "s": F.stddev_samp})
    # a constant column gets an infinite deviation, hence no z-score outliers
    k = {c: {"lo": fences[c][0], "hi": fences[c][1], "m": stats[c]["m"], "s": stats[c]["s"] or float("inf")} for c in cols if c in fences}
    n = df.count()
    long = per_feature(
        df, list(k),
        {
            "iqr_outliers": lambda x, k: F.count_if((x < k["lo"]) | (x > k["hi"])),
            "zscore_outliers": lambda x, k: F.count_if(F.abs((x - k["m"]) / k["s"]) >= z),
            "lower_fence": lambda x, k: F.max(k["lo"]),
            "upper_fence": lambda x, k: F.max(k["hi"]),
        },
        constants=k,
    ).withColumn("n", F.lit(float(max(n, 1))))
    return long.select(
        "feature", "iqr_outliers", rounded_even(F.col("iqr_outliers") * 100.0 / F.col("n"), 4).alias("iqr_outlier_pct"),
        "zscore_outliers", rounded_even(F.col("zscore_outliers") * 100.0 / F.col("n"), 4).alias("zscore_outlier_pct"),
        "lower_fence", "upper_fence",
    )


def distribution_shape(df: DataFrame, columns: Sequence[str], skew: float = 1.0, kurt: float = 3.0) -> DataFrame:
    return shape_stats(df, columns).withColumns(
        {
            "highly_skewed": F.abs("skewness") >= skew,
            "heavy_tailed": F.col("excess_kurtosis") >= kurt,
            "non_normality": F.abs("skewness") + F.abs("excess_kurtosis"),
        }
    )


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bin counts per column, empty bins included."""
    cols = list(columns)
    ends = df.sparkSession.createDataFrame(
        [(c, v["lo"], v["hi"]) for c, v in feature_numbers(df, cols, {"lo": F.min, "hi": F.max}).items()], "feature string, lo double, hi double"
    )
    cells = melt(df, cols).filter(F.col("value").isNotNull()).join(F.broadcast(ends), "feature")  # one row per column
    counted = cells.groupBy("feature", binned(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(c, b) for c in cols for b in range(bins)], "feature string, bin int")
    return grid.join(counted, ["feature", "bin"], "left").select("feature", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def ratio_categories(df: DataFrame, target: str) -> DataFrame:
    """Financial category of every numeric feature, from its name."""
    names = df.sparkSession.createDataFrame([(c,) for c in numeric_columns(df, skip=[target])], "feature string")
    return names.withColumn("category", category_of("feature"))
