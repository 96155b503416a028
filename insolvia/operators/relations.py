"""Feature-feature and feature-target association."""
from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import category_of, melt, number_or_null
from ..session import materialize
from .order import EXPRESSIONS_PER_JOB, _batched, quantiles, running_totals
from .profile import value_counts
from .skew import join_to_keys
from .wide import feature_numbers, per_feature


def correlation(a: Column, b: Column) -> Column:
    """Pearson r over rows where both are present; null when either is constant."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """k x k Pearson matrix on the driver (bounded by the column count), NaN for constants.

    Tables without gaps take one pass of cross products, however many columns there are.
    With gaps every pair has its own set of complete rows; those pairs are batched into a
    few wide aggregates.
    """
    cols = list(columns)
    k = len(cols)
    df = df.select(*[number_or_null(c).alias(c) for c in cols])
    n = df.count()
    ends = feature_numbers(df, cols, {"n": F.count, "lo": F.min, "hi": F.max})
    varies = [i for i, c in enumerate(cols) if ends[c]["n"] and ends[c]["lo"] < ends[c]["hi"]]
    m = np.full((k, k), np.nan)
    for i in varies:
        m[i, i] = 1.0
    whole = [i for i in varies if ends[cols[i]]["n"] == n]
    if len(whole) > 8:
        vec = VectorAssembler(inputCols=[cols[i] for i in whole], outputCol="v").transform(df).select("v")
        m[np.ix_(whole, whole)] = Correlation.corr(vec, "v").first()[0].toArray()
        done = set(whole)
    else:
        done = set()
    pairs = [(i, j) for i, j in itertools.combinations(varies, 2) if not (i in done and j in done)]
    for batch in _batched(pairs, EXPRESSIONS_PER_JOB // 6):
        row = df.agg(*[correlation(F.col(cols[i]), F.col(cols[j])).alias(f"r{p}") for p, (i, j) in enumerate(batch)]).first()
        for p, (i, j) in enumerate(batch):
            if row[f"r{p}"] is not None:
                m[i, j] = m[j, i] = row[f"r{p}"]
    return m


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle (feature_a, feature_b, r); null for constants."""
    m = correlation_matrix(df, columns)
    rows = [(columns[i], columns[j], None if math.isnan(m[i, j]) else float(m[i, j])) for i, j in itertools.combinations(range(len(columns)), 2)]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def matrix_table(df: DataFrame, columns: Sequence[str], m: np.ndarray) -> DataFrame:
    rows = [(a, b, None if math.isnan(m[i, j]) else float(m[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return matrix_table(df, columns, correlation_matrix(df, columns))


def average_ranks(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, feature, rank): rank among all rows, ties sharing their mean rank."""
    freq = value_counts(df, columns)
    ranked = running_totals(freq, ["feature"], ["value"], {"upto": "n"}).select(
        "feature", "value", (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"), "n"
    )
    long = melt(df, columns, keep=[key]).filter(F.col("value").isNotNull())
    return join_to_keys(long, ranked, ["feature", "value"], "n").select(key, "feature", "rank")


def spearman(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    ranks = average_ranks(df, key, columns).groupBy(key).pivot("feature", list(columns)).agg(F.first("rank"))
    return pearson(materialize(ranks, "ranks"), columns)


def kendall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact tau-b per feature pair without comparing rows pairwise.

    x is replaced by its dense rank.  Two points are ordered by x at the highest bit in
    which their ranks differ, so per bit level the points sharing the higher bits are
    swept in y order and every 1-bit point adds the number of 0-bit points below it.
    That is n log n rows in one ordered running total, however large n is.
    """
    cols = list(columns)
    freq = value_counts(df, cols)
    dense = running_totals(freq.withColumn("one", F.lit(1)), ["feature"], ["value"], {"rank": "one"})
    dense = dense.select("feature", F.col("value").alias("x"), "rank", "n")
    dense = materialize(dense, "dense")
    top = dense.agg(F.max("rank")).first()[0] or 1
    bits = int(top).bit_length()
    structs = [
        F.struct(F.lit(a).alias("feature"), F.lit(b).alias("feature_b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for a, b in itertools.combinations(cols, 2)
    ]
    points = materialize(
        df.select(*cols)
        .select(F.explode(F.array(*structs)).alias("s"))
        .select("s.*")
        .dropna()
        .groupBy("feature", "feature_b", "x", "y")
        .agg(F.count("*").alias("n")),
        "points",
    )
    pair = ["feature", "feature_b"]
    ranked = join_to_keys(points, dense.withColumnRenamed("n", "weight"), ["feature", "x"], "weight")
    levels = ranked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    bit = F.expr("shiftright(rank, level) & 1")
    sides = (
        levels.withColumn("prefix", F.expr("shiftright(rank, level + 1)"))
        .groupBy(*pair, "level", "prefix", "y")
        .agg(F.sum(F.when(bit == 0, F.col("n")).otherwise(0)).alias("w0"), F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).alias("w1"))
    )
    swept = running_totals(sides, [*pair, "level", "prefix"], ["y"], {"upto": "w0"})
    concordant = swept.groupBy(*pair).agg(
        F.sum((F.col("w1").cast("decimal(19,0)") * (F.col("upto") - F.col("w0")).cast("decimal(19,0)"))).cast("double").alias("c")
    )
    ties = lambda n: F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2.0)
    totals = points.groupBy(*pair).agg(F.sum("n").cast("double").alias("m"), ties("n").alias("txy"))
    tx = points.groupBy(*pair, "x").agg(F.sum("n").alias("n")).groupBy(*pair).agg(ties("n").alias("tx"))
    ty = points.groupBy(*pair, "y").agg(F.sum("n").alias("n")).groupBy(*pair).agg(ties("n").alias("ty"))
    n0 = F.col("m") * (F.col("m") - 1) / 2.0
    discordant = n0 - F.col("tx") - F.col("ty") + F.col("txy") - F.col("c")
    tau = F.try_divide(F.col("c") - discordant, F.sqrt(n0 - F.col("tx")) * F.sqrt(n0 - F.col("ty")))
    return totals.join(concordant, pair).join(tx, pair).join(ty, pair).select(F.col("feature").alias("feature_a"), "feature_b", tau.alias("tau"))


def high_pairs(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    return pairs.filter(F.abs("r") >= threshold).orderBy(F.abs("r").desc(), "feature_a", "feature_b")


def vif_from_matrix(m: np.ndarray, floor: float = 0.0, ceiling: float = math.inf) -> np.ndarray:
    return np.clip(np.diag(np.linalg.pinv(np.nan_to_num(m, nan=0.0))), floor, ceiling)


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    vif = vif_from_matrix(correlation_matrix(df, columns))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, vif)], "feature string, vif double")


# ---------------------------------------------------------------- against the target
def class_moments(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Per feature: n, avg, var, sum, min in each class (suffix 0 or 1) of a 0/1 target, one scan."""
    names = ("n", "avg", "var", "sum", "min")
    aggs = dict(zip(names, (F.count, F.avg, F.var_samp, F.sum, F.min)))
    per_class = per_feature(df.filter(F.col(target).isin(0, 1)), columns, aggs, by=[target])
    return per_class.groupBy("feature").agg(
        *[F.coalesce(F.max(F.when(F.col(target) == y, F.col(n))), F.lit(0) if n == "n" else F.lit(None)).alias(f"{n}{y}") for n in names for y in (0, 1)]
    )


def cohens_d(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Standardised mean difference (class 1 minus class 0) with pooled deviation."""
    m = class_moments(df, target, columns).filter((F.col("n0") >= 2) & (F.col("n1") >= 2))
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1")) / (F.col("n0") + F.col("n1") - 2))
    d = F.coalesce(F.try_divide(F.col("avg1") - F.col("avg0"), pooled), F.lit(0.0))
    return m.select(
        "feature", category_of("feature").alias("category"), F.col("avg0").alias("mean_solvent"), F.col("avg1").alias("mean_bankrupt"),
        d.alias("cohens_d"), F.abs(d).alias("abs_cohens_d"),
    )


def category_strength(discrimination: DataFrame) -> DataFrame:
    return discrimination.groupBy("category").agg(F.count("*").alias("n_features"), F.avg("abs_cohens_d").alias("mean_abs_d"))


def correlation_with(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Point-biserial r per feature, 0 for constants."""
    if len(columns) > 8:
        long = melt(df, columns, keep=[target])
        return long.groupBy("feature").agg(F.coalesce(correlation(F.col("value"), F.col(target)), F.lit(0.0)).alias("r"))
    row = df.agg(*[F.coalesce(correlation(F.col(c), F.col(target)), F.lit(0.0)).alias(f"r{i}") for i, c in enumerate(columns)])
    return row.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(columns)])).alias("s")
    ).select("s.*")


def mutual_information(df: DataFrame, target: str, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information (nats) between quantile-binned features and the label.

    The estimator is binned, not nearest-neighbour: exact quantile edges, then counts.
    """
    edges = quantiles(df, columns, [i / bins for i in range(1, bins)])
    table = df.sparkSession.createDataFrame([(c, sorted({e for e in edges[c] if e is not None})) for c in columns], "feature string, edges array<double>")
    long = melt(df, columns, keep=[target]).filter(F.col("value").isNotNull()).join(F.broadcast(table), "feature")  # one row per column
    b = F.size(F.filter("edges", lambda e: F.col("value") > e))
    cells = long.groupBy("feature", b.alias("bin"), F.col(target).alias("y")).agg(F.count("*").cast("double").alias("n"))
    # the cell table has at most features x bins x classes rows
    total = cells.groupBy("feature").agg(F.sum("n").alias("t"))
    by_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_y = cells.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    joined = cells.join(total, "feature").join(by_bin, ["feature", "bin"]).join(by_y, ["feature", "y"])
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))
    return joined.groupBy("feature").agg(F.sum(term).alias("mutual_info"))


def rank_auc(
    freq: DataFrame, group: Sequence[str], value: str = "value", n: str = "n", pos: str = "pos", is_stored: bool = False
) -> DataFrame:
    """AUC per group from value counts: every positive beats the negatives below it and
    half of those tied with it."""
    group = list(group)
    freq = freq.withColumn("_neg", F.col(n) - F.col(pos))
    swept = running_totals(freq, group, [value], {"_upto": "_neg"}, is_stored)
    wins = F.col(pos).cast("double") * (F.col("_upto") - F.col("_neg") / 2.0)
    agg = swept.groupBy(*group) if group else swept.groupBy()
    out = agg.agg(F.sum(wins).alias("_w"), F.sum(pos).cast("double").alias("_p"), F.sum("_neg").cast("double").alias("_n"))
    return out.select(*group, F.coalesce(F.try_divide("_w", F.col("_p") * F.col("_n")), F.lit(0.5)).alias("auc"))


def univariate_auc(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    out = rank_auc(value_counts(df, columns, target), ["feature"])
    return out.select("feature", "auc", (F.abs(F.col("auc") - 0.5) * 2).alias("separability"))


def anova_f(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    m = class_moments(df, target, columns)
    n = F.col("n0") + F.col("n1")
    grand = (F.col("n0") * F.col("avg0") + F.col("n1") * F.col("avg1")) / n
    between = F.col("n0") * (F.col("avg0") - grand) ** 2 + F.col("n1") * (F.col("avg1") - grand) ** 2
    within = (F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1")
    return m.select("feature", F.try_divide(between, within / (n - 2)).alias("f_score"))


def chi_square(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Observed against expected class sums of the min-shifted feature."""
    m = class_moments(df, target, columns)
    low = F.least("min0", "min1")
    o0, o1 = F.col("sum0") - F.col("n0") * low, F.col("sum1") - F.col("n1") * low
    n = F.col("n0") + F.col("n1")
    e0, e1 = (o0 + o1) * F.col("n0") / n, (o0 + o1) * F.col("n1") / n
    return m.select("feature", (F.try_divide((o0 - e0) ** 2, e0) + F.try_divide((o1 - e1) ** 2, e1)).alias("chi2"))
