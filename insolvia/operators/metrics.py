"""Threshold-aware evaluation of scored binary labels.

Everything starts from counts per distinct score, so a table of any length shrinks
before it is ordered, and ties are handled exactly.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .order import bucket_by_cuts, cut_at, quantiles, running_totals
from .relations import rank_auc

# Fixed value: probabilities are kept this far from 0 and 1 in the log loss.
LOG_EPS = float(np.finfo("float64").eps)
# Metrics a leaderboard is ranked by, in order.
RANKING = ("roc_auc", "f1", "recall", "pr_auc")


def score_counts(df: DataFrame, label: str = "y", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(by…, p, n, pos) with scores clipped to [0, 1]."""
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0))
    return df.groupBy(*by, p.alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))


def stored_counts(df: DataFrame, label: str = "y", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """Score counts written once, for callers that read them several times."""
    return materialize(score_counts(df, label, score, by), "scores")


def sweep(counts: DataFrame, by: Sequence[str] = (), is_stored: bool = False) -> DataFrame:
    """Cumulative rows and positives at or above each distinct score."""
    down = counts.withColumn("_down", -F.col("p"))
    return running_totals(down, list(by), ["_down"], {"upto": "n", "tp": "pos"}, is_stored).drop("_down").withColumn("fp", F.col("upto") - F.col("tp"))


def class_totals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("pos").alias("positives"))


def _with_totals(frame: DataFrame, counts: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = class_totals(counts, by)
    if by:
        return frame.join(totals, list(by))
    row = totals.first()
    return frame.withColumns({c: F.lit(row[c]).cast("bigint") for c in ("total", "positives")})


def confusion(df: DataFrame, threshold: float, label: str = "y", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    hit = F.col(score) >= F.lit(float(threshold))
    y = F.col(label) == 1
    aggs = [F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(y & hit).alias("tp")]
    return df.groupBy(*by).agg(*aggs)


def threshold_metrics(matrix: DataFrame) -> DataFrame:
    """Closed-form metrics over a confusion matrix; undefined precision/recall/F1 are 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    recall = zero(F.try_divide(tp, tp + fn))
    specificity = F.try_divide(tn, tn + fp)
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    accuracy = (tp + tn) / n
    return matrix.withColumns(
        {
            "accuracy": accuracy,
            "precision": zero(F.try_divide(tp, tp + fp)),
            "recall": recall,
            "f1": zero(F.try_divide(2 * tp, 2 * tp + fp + fn)),
            "balanced_accuracy": (recall + specificity) / 2,
            "mcc": zero(F.try_divide(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))),
            "cohen_kappa": F.try_divide(accuracy - chance, 1 - chance),
        }
    )


def roc_auc(counts: DataFrame, by: Sequence[str] = (), is_stored: bool = False) -> DataFrame:
    return rank_auc(counts, list(by), value="p", is_stored=is_stored).withColumnRenamed("auc", "roc_auc")


def average_precision(counts: DataFrame, by: Sequence[str] = (), is_stored: bool = False) -> DataFrame:
    """Step sum of precision over recall gains, one step per distinct score."""
    swept = _with_totals(sweep(counts, by, is_stored), counts, by)
    step = (F.col("pos") / F.col("positives")) * (F.col("tp") / F.col("upto"))
    return swept.groupBy(*by).agg(F.sum(step).alias("pr_auc"))


def probability_losses(df: DataFrame, label: str = "y", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))
    y = F.col(label)
    loss = F.when(y == 1, -F.log(p)).otherwise(-F.log(1 - p))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"), F.avg((F.col(score) - y) ** 2).alias("brier_score"))


def evaluate(df: DataFrame, threshold: float, label: str = "y", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """The whole metric suite, one row per group."""
    counts = stored_counts(df, label, score, by)
    parts = [
        threshold_metrics(confusion(df, threshold, label, score, by)),
        roc_auc(counts, by, is_stored=True),
        average_precision(counts, by, is_stored=True),
        probability_losses(df, label, score, by),
    ]
    if by:
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, list(by))
        return out
    out = parts[0]
    for part in parts[1:]:  # single rows: attach as literals
        row = part.first()
        out = out.withColumns({c: F.lit(row[c]) for c in part.columns})
    return out


def youden_threshold(counts: DataFrame) -> float:
    """Score with the largest TPR - FPR, ties to the highest score, kept within [0, 1]."""
    t = class_totals(counts).first()
    pos, neg = t["positives"], t["total"] - t["positives"]
    if not pos or not neg:
        return 0.5
    gap = F.col("tp") / F.lit(float(pos)) - F.col("fp") / F.lit(float(neg))
    best = sweep(counts, is_stored=True).agg(F.max(F.struct(gap.alias("j"), "p")).alias("b")).first()["b"]
    return float(best["p"]) if best["j"] > 0 else 1.0


def max_f1_threshold(counts: DataFrame) -> float:
    """The score with the largest F1 of all distinct scores, ties to the lowest."""
    t = class_totals(counts).first()
    if not t["positives"] or t["positives"] == t["total"]:
        return 0.5
    f1 = 2.0 * F.col("tp") / (F.col("upto") + F.lit(t["positives"]))
    best = sweep(counts, is_stored=True).agg(F.max(F.struct(f1.alias("f1"), (-F.col("p")).alias("down"))).alias("b")).first()["b"]
    return -float(best["down"])


def choose_threshold(counts: DataFrame, method: str = "youden", custom: float = 0.5) -> tuple[float, str]:
    if method == "custom":
        return custom, "custom"
    counts = materialize(counts, "scores")
    t = class_totals(counts).first()
    if not t["positives"] or t["positives"] == t["total"]:
        return 0.5, "default"
    if method == "youden":
        return youden_threshold(counts), "youden"
    if method in ("max_f1", "f1"):
        return max_f1_threshold(counts), "max_f1"
    return 0.5, "default"


def calibration_curve(df: DataFrame, label: str = "y", score: str = "p", bins: int = 10) -> DataFrame:
    """Observed rate and mean score in quantile bins."""
    edges = quantiles(df, [score], [i / bins for i in range(1, bins)])[score]
    b = F.lit(0)
    for e in edges:
        b = b + F.when(F.col(score) > F.lit(e), 1).otherwise(0)
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("fraction_positive"))


def cumulative_lift(df: DataFrame, label: str = "y", score: str = "p", key: str = "id") -> DataFrame:
    """Positive rate of the top 10..100 % over the base rate; score ties in key order."""
    frame = materialize(df.select((-F.col(score)).alias("_down"), key, label), "lift")
    n = frame.count()
    fractions = [float(f) for f in np.linspace(0.1, 1.0, 10)]
    sizes = [max(1, int(f * n)) for f in fractions]
    cuts = cut_at(frame, ["_down", key], sizes)
    found = frame.groupBy(bucket_by_cuts(cuts).alias("b")).agg(F.count("*").alias("n"), F.sum(label).alias("pos")).collect()  # <= 11 rows
    at = {r["b"]: (r["n"], r["pos"]) for r in found}
    total = sum(p for _, p in at.values())
    base = total / n if total else 1e-9
    rows, seen, hits = [], 0, 0
    for i, f in enumerate(fractions):
        seen, hits = seen + at.get(i, (0, 0))[0], hits + at.get(i, (0, 0))[1]
        rows.append((round(f, 1), seen, hits, hits / seen / base))
    return df.sparkSession.createDataFrame(rows, "fraction double, n bigint, positives bigint, lift double")


def curve_points(counts: DataFrame) -> DataFrame:
    """ROC and precision-recall coordinates per distinct score."""
    swept = _with_totals(sweep(counts), counts, [])
    return swept.select(
        F.col("p").alias("threshold"),
        (F.col("fp") / (F.col("total") - F.col("positives"))).alias("fpr"),
        (F.col("tp") / F.col("positives")).alias("tpr"),
        (F.col("tp") / F.col("upto")).alias("precision"),
        (F.col("tp") / F.col("positives")).alias("recall"),
    )


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight per class, and the negative/positive ratio used by boosted trees."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    t = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum(F.when(F.col("class") == 1, F.col("n")).otherwise(0)).alias("p")).first()
    return counts.withColumns(
        {
            "balanced_weight": F.lit(float(t["t"])) / (F.lit(float(t["k"])) * F.col("n")),
            "scale_pos_weight": F.lit((t["t"] - t["p"]) / max(t["p"], 1)),
        }
    )


def leaderboard(rows: DataFrame, ranking: Sequence[str] = RANKING) -> DataFrame:
    """Rank models by the metrics in turn, missing ones last.  One row per model."""
    order = [F.col(c).desc_nulls_last() for c in ranking] + [F.col("model")]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def compare_families(boards: dict[str, DataFrame], ranking: Sequence[str] = RANKING) -> DataFrame:
    out = None
    for family, board in boards.items():
        part = board.drop("rank").withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return leaderboard(out, ranking)
