"""Evaluation, thresholds, curves, leaderboards, scoring and request metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import metrics as m
from ..operators import scoring as sc
from ..operators import series as se
from . import tables as t
from .registry import query
from .tables import FIRMS, SCORES, r, sql_with

MATRIX = """cm AS (SELECT COUNT(*) FILTER (y = 0 AND p < 0.4) AS tn, COUNT(*) FILTER (y = 0 AND p >= 0.4) AS fp,
  COUNT(*) FILTER (y = 1 AND p < 0.4) AS fn, COUNT(*) FILTER (y = 1 AND p >= 0.4) AS tp FROM scores)"""
COUNTS = "cnt AS (SELECT p, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS pos FROM scores GROUP BY p)"
SWEPT = """swept AS (SELECT p, n, pos, SUM(n) OVER w AS upto, SUM(pos) OVER w AS tp, SUM(n - pos) OVER w AS fp, SUM(pos) OVER () AS positives, SUM(n) OVER () AS total
  FROM cnt WINDOW w AS (ORDER BY p DESC))"""

CLOSED = {
    "accuracy": "(tp + tn)::DOUBLE / (tp + tn + fp + fn)",
    "precision": "tp::DOUBLE / (tp + fp)",
    "recall": "tp::DOUBLE / (tp + fn)",
    "f1": "2.0::DOUBLE * tp / (2 * tp + fp + fn)",
    "balanced_accuracy": "(tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2",
    "mcc": "(tp * tn - fp * fn)::DOUBLE / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn))",
    "cohen_kappa": "((tp + tn)::DOUBLE / (tp + tn + fp + fn) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp))::DOUBLE / (tp + tn + fp + fn) ** 2) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp))::DOUBLE / (tp + tn + fp + fn) ** 2)",
}
AUC_SQL = "(SELECT SUM(pos * (below + (n - pos) / 2)) / (SUM(pos) * SUM(n - pos)) FROM (SELECT pos, n, SUM(n - pos) OVER (ORDER BY p) - (n - pos) AS below FROM cnt))"
AP_SQL = "(SELECT SUM(pos / positives * tp / upto) FROM swept)"
LOSS_SQL = "(SELECT AVG(-ln(CASE WHEN y = 1 THEN greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16) ELSE 1 - greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16) END)) FROM scores)"
BRIER_SQL = "(SELECT AVG((p - y) ** 2) FROM scores)"


def _counts(spark, sf):
    return m.score_counts(t.scores(spark, sf))


@query("confusion_matrix", sql_with(SCORES, MATRIX, body="SELECT tn, fp, fn, tp FROM cm"))
def _confusion(spark, sf):
    return m.confusion(t.scores(spark, sf), 0.4)


@query("threshold_metrics", sql_with(SCORES, MATRIX, body="SELECT tn, fp, fn, tp, " + ", ".join(f"{r(e)} AS {k}" for k, e in CLOSED.items()) + " FROM cm"))
def _closed(spark, sf):
    return m.threshold_metrics(m.confusion(t.scores(spark, sf), 0.4)).withColumns({k: rounded(k) for k in CLOSED})


@query("roc_auc", sql_with(SCORES, COUNTS, body=f"SELECT {r(AUC_SQL)} AS roc_auc"))
def _auc(spark, sf):
    return m.roc_auc(_counts(spark, sf)).select(rounded("roc_auc").alias("roc_auc"))


@query("average_precision", sql_with(SCORES, COUNTS, SWEPT, body=f"SELECT {r(AP_SQL)} AS pr_auc"))
def _ap(spark, sf):
    return m.average_precision(_counts(spark, sf)).select(rounded("pr_auc").alias("pr_auc"))


@query("probability_losses", sql_with(SCORES, body=f"SELECT {r(LOSS_SQL)} AS log_loss, {r(BRIER_SQL)} AS brier_score"))
def _losses(spark, sf):
    return m.probability_losses(t.scores(spark, sf)).select(rounded("log_loss").alias("log_loss"), rounded("brier_score").alias("brier_score"))


@query(
    "full_evaluation",
    sql_with(
        SCORES, MATRIX, COUNTS, SWEPT,
        body="SELECT tn, fp, fn, tp, " + ", ".join(f"{r(e)} AS {k}" for k, e in {**CLOSED, "roc_auc": AUC_SQL, "pr_auc": AP_SQL, "log_loss": LOSS_SQL, "brier_score": BRIER_SQL}.items()) + " FROM cm",
    ),
)
def _evaluate(spark, sf):
    out = m.evaluate(t.scores(spark, sf), 0.4)
    return out.withColumns({c: rounded(c) for c in out.columns if c not in ("tn", "fp", "fn", "tp")})


@query(
    "youden_threshold",
    sql_with(SCORES, COUNTS, SWEPT, body="SELECT p AS threshold, 'youden' AS method FROM swept ORDER BY tp / positives - fp / (total - positives) DESC, p DESC LIMIT 1"),
)
def _youden(spark, sf):
    return spark.createDataFrame([m.choose_threshold(_counts(spark, sf), "youden")], "threshold double, method string")


@query(
    "max_f1_threshold",
    sql_with(
        SCORES, COUNTS,
        "at_least AS (SELECT p, SUM(n) OVER w AS upto, SUM(pos) OVER w AS tp, SUM(pos) OVER () AS positives FROM cnt WINDOW w AS (ORDER BY p DESC))",
        body=f"SELECT {r('p')} AS threshold, 'max_f1' AS method FROM at_least ORDER BY 2.0::DOUBLE * tp / (upto + positives) DESC, at_least.p LIMIT 1",
    ),
)
def _f1(spark, sf):
    found = spark.createDataFrame([m.choose_threshold(_counts(spark, sf), "max_f1")], "threshold double, method string")
    return found.withColumn("threshold", rounded("threshold"))


@query(
    "calibration_curve",
    sql_with(
        SCORES,
        f"edges AS (SELECT quantile_cont(p, {[i / 10 for i in range(1, 10)]}) AS e FROM scores)",
        body=f"SELECT CAST(len(list_filter(e, lambda x: p > x)) AS INTEGER) AS bin, COUNT(*) AS n, {r('AVG(p)')} AS mean_predicted, {r('AVG(y)')} AS fraction_positive FROM scores, edges GROUP BY 1",
    ),
)
def _calibration(spark, sf):
    out = m.calibration_curve(t.scores(spark, sf))
    return out.withColumns({c: rounded(c) for c in ("mean_predicted", "fraction_positive")})


@query(
    "cumulative_lift",
    sql_with(
        SCORES,
        body=f"""SELECT round(f, 1) AS fraction, k AS n, COUNT(*) FILTER (y = 1) AS positives, {r('COUNT(*) FILTER (y = 1)::DOUBLE / k / MAX(base)')} AS lift
        FROM (SELECT y, ROW_NUMBER() OVER (ORDER BY p DESC, id) AS rn, AVG(y) OVER () AS base FROM scores),
          (SELECT f, greatest(1, CAST(floor(f * (SELECT COUNT(*) FROM scores)) AS BIGINT)) AS k FROM (SELECT unnest([0.1::DOUBLE, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6, 0.7000000000000001, 0.8, 0.9, 1.0]) AS f))
        WHERE rn <= k GROUP BY f, k""",
    ),
)
def _lift(spark, sf):
    return m.cumulative_lift(t.scores(spark, sf)).withColumn("lift", rounded("lift"))


@query(
    "cumulative_gain",
    sql_with(
        SCORES,
        body=f"SELECT id, ROW_NUMBER() OVER w AS position, {r('ROW_NUMBER() OVER w / (COUNT(*) OVER ())::DOUBLE')} AS fraction, {r('SUM(y) OVER w / (SUM(y) OVER ())::DOUBLE')} AS gain FROM scores WINDOW w AS (ORDER BY p DESC, id)",
    ),
)
def _gain(spark, sf):
    out = se.cumulative_gain(t.scores(spark, sf), "p", "y", "id")
    return out.select("id", "position", rounded("fraction").alias("fraction"), rounded("gain").alias("gain"))


@query(
    "curve_points",
    sql_with(
        SCORES, COUNTS, SWEPT,
        body=f"SELECT p AS threshold, {r('fp / (total - positives)')} AS fpr, {r('tp / positives')} AS tpr, {r('tp / upto')} AS precision, {r('tp / positives')} AS recall FROM swept",
    ),
)
def _curves(spark, sf):
    out = m.curve_points(_counts(spark, sf))
    return out.withColumns({c: rounded(c) for c in ("fpr", "tpr", "precision", "recall")})


@query(
    "class_weights",
    sql_with(FIRMS, body=f"SELECT target AS class, COUNT(*) AS n, {r('(SELECT COUNT(*) FROM firms) / (2.0 * COUNT(*))')} AS balanced_weight, {r('(SELECT COUNT(*) FILTER (target = 0)::DOUBLE / COUNT(*) FILTER (target = 1) FROM firms)')} AS scale_pos_weight FROM firms GROUP BY target"),
)
def _weights(spark, sf):
    return m.class_weights(t.firms(spark, sf), "target").withColumns({c: rounded(c) for c in ("balanced_weight", "scale_pos_weight")})


def _board(spark, sf, power: float, prefix: str):
    """Score variants of the same rows as stand-ins for competing models."""
    base = t.scores(spark, sf)
    models = F.array(*[F.struct(F.lit(f"{prefix}_{i}").alias("model"), F.lit(float(i) * power).alias("w")) for i in range(1, 4)])
    long = base.withColumn("m", F.explode(models)).select("id", "y", F.col("m.model").alias("model"), F.pow("p", F.col("m.w")).alias("p"))
    long = long.withColumn("p", F.when(F.col("id") % 3 == 0, 1 - F.col("p")).otherwise(F.col("p")) if prefix == "b" else F.col("p"))
    out = m.evaluate(long, 0.4, by=["model"]).select("model", *m.RANKING)
    return out.withColumns({c: rounded(c) for c in m.RANKING})


def _board_sql(name, prefix, power, flip):
    p = f"pow(p, i * {power}::DOUBLE)"
    if flip:
        p = f"CASE WHEN id % 3 = 0 THEN 1 - {p} ELSE {p} END"
    long = f"{name}l AS (SELECT '{prefix}_' || i AS model, id, y, {p} AS p FROM scores, (SELECT unnest([1, 2, 3]) AS i))"
    cnt = f"{name}c AS (SELECT model, p, COUNT(*)::DOUBLE AS n, SUM(y)::DOUBLE AS pos FROM {name}l GROUP BY model, p)"
    sw = f"{name}s AS (SELECT model, n, pos, SUM(n) OVER w AS upto, SUM(pos) OVER w AS tp, SUM(n - pos) OVER v AS below, SUM(pos) OVER (PARTITION BY model) AS positives, SUM(n) OVER (PARTITION BY model) AS total FROM {name}c WINDOW w AS (PARTITION BY model ORDER BY p DESC), v AS (PARTITION BY model ORDER BY p))"
    board = f"""{name} AS (SELECT a.model, {r('SUM(pos * (below - (n - pos) / 2)) / MAX(positives * (total - positives))')} AS roc_auc, MAX(f1) AS f1, MAX(recall) AS recall, {r('SUM(pos / positives * tp / upto)')} AS pr_auc
      FROM {name}s a JOIN (SELECT model, {r('2.0::DOUBLE * COUNT(*) FILTER (y = 1 AND p >= 0.4) / (COUNT(*) FILTER (p >= 0.4) + COUNT(*) FILTER (y = 1))')} AS f1,
        {r('COUNT(*) FILTER (y = 1 AND p >= 0.4)::DOUBLE / COUNT(*) FILTER (y = 1)')} AS recall FROM {name}l GROUP BY model) b ON a.model = b.model GROUP BY a.model)"""
    return ", ".join([long, cnt, sw, board])


RANK_SQL = "CAST(ROW_NUMBER() OVER (ORDER BY roc_auc DESC NULLS LAST, f1 DESC NULLS LAST, recall DESC NULLS LAST, pr_auc DESC NULLS LAST, model) AS INTEGER) AS rank"


@query("leaderboard", sql_with(SCORES, _board_sql("plain", "a", 1.0, False), body=f"SELECT model, roc_auc, f1, recall, pr_auc, {RANK_SQL} FROM plain"))
def _leaderboard(spark, sf):
    return m.leaderboard(_board(spark, sf, 1.0, "a"))


@query(
    "family_comparison",
    sql_with(
        SCORES, _board_sql("plain", "a", 1.0, False), _board_sql("noisy", "b", 0.5, True),
        body=f"SELECT model, family, roc_auc, f1, recall, pr_auc, {RANK_SQL} FROM (SELECT *, 'plain' AS family FROM plain UNION ALL SELECT *, 'noisy' FROM noisy)",
    ),
)
def _families(spark, sf):
    boards = {"plain": m.leaderboard(_board(spark, sf, 1.0, "a")), "noisy": m.leaderboard(_board(spark, sf, 0.5, "b"))}
    return m.compare_families(boards)


# ---------------------------------------------------------------- scoring
RISK = "round_even(p * 100.0::DOUBLE * 10.0::DOUBLE, 0) / 10.0::DOUBLE"
BAND = "CASE WHEN {0} < 33 THEN 'Low' WHEN {0} < 66 THEN 'Medium' ELSE 'High' END"


@query("risk_score_band", sql_with(SCORES, body=f"SELECT id, {RISK} AS risk_score, round_even(p * 1e4::DOUBLE, 0) / 1e4::DOUBLE AS probability, {BAND.format(RISK)} AS risk_level FROM scores"))
def _risk(spark, sf):
    out = sc.risk_columns(t.scores(spark, sf).withColumnRenamed("p", "probability"))
    return out.select("id", "risk_score", "probability", "risk_level")


@query(
    "batch_scoring",
    sql_with(
        SCORES,
        body=f"""SELECT id, CASE WHEN p >= 0.439 THEN 1 ELSE 0 END AS prediction, round_even(p * 1e6::DOUBLE, 0) / 1e6::DOUBLE AS probability, {RISK} AS risk_score, {BAND.format(RISK)} AS risk_level,
          round_even(least(abs(p - 0.439::DOUBLE) / CASE WHEN p >= 0.439 THEN 1.0::DOUBLE - 0.439::DOUBLE ELSE 0.439::DOUBLE END, 1.0) * 1e4::DOUBLE, 0) / 1e4::DOUBLE AS confidence_score,
          0.439::DOUBLE AS threshold, 'v001' AS model_version, 'logistic_regression' AS algorithm, '2024-01-20T00:00:00' AS prediction_timestamp FROM scores""",
    ),
)
def _score(spark, sf):
    return sc.score(t.scores(spark, sf), "p", 0.439, "v001", "logistic_regression", F.lit("2024-01-20T00:00:00"))


@query(
    "confidence_by_side",
    sql_with(
        SCORES,
        body=f"SELECT CASE WHEN p >= 0.439 THEN 1 ELSE 0 END AS prediction, COUNT(*) AS n, {r('AVG(least(abs(p - 0.439::DOUBLE) / CASE WHEN p >= 0.439 THEN 1.0::DOUBLE - 0.439::DOUBLE ELSE 0.439::DOUBLE END, 1.0))', 5)} AS mean_confidence FROM scores GROUP BY 1",
    ),
)
def _confidence(spark, sf):
    from ..functions.scalars import confidence

    s = t.scores(spark, sf)
    return s.groupBy(F.when(F.col("p") >= 0.439, 1).otherwise(0).alias("prediction")).agg(F.count("*").alias("n"), rounded(F.avg(confidence("p", 0.439)), 5).alias("mean_confidence"))


def request_log(spark, sf):
    """events read as a request log: purchases are prediction calls, the rest requests."""
    ev = t.table(spark, sf, "events")
    return ev.select(
        "ts", F.when(F.col("event_type") == "purchase", "prediction").otherwise("request").alias("kind"),
        F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("is_error"),
        (F.col("user_id") % 5 + 1).alias("predictions"), (F.col("value") / 2).alias("inference_ms"),
    )


@query(
    "request_metrics",
    """SELECT COUNT(*) FILTER (event_type <> 'purchase') AS request_count, CAST(SUM(user_id % 5 + 1) FILTER (event_type = 'purchase') AS BIGINT) AS prediction_count, COUNT(*) FILTER (event_type = 'error') AS error_count,
      round_even(AVG(value) FILTER (event_type <> 'purchase') * 1e3::DOUBLE, 0) / 1e3::DOUBLE AS avg_latency_ms, round_even(AVG(value / 2) FILTER (event_type = 'purchase') * 1e3::DOUBLE, 0) / 1e3::DOUBLE AS avg_inference_ms, 'v001' AS active_model_version FROM events""",
)
def _requests(spark, sf):
    return sc.request_snapshot(request_log(spark, sf), "v001")


@query(
    "model_listing",
    sql_with(
        SCORES, _board_sql("plain", "a", 1.0, False),
        body="SELECT model, 'v00' || right(model, 1) AS model_version, roc_auc, f1, model = 'a_1' AS is_best FROM plain",
    ),
)
def _models(spark, sf):
    reg = _board(spark, sf, 1.0, "a").select("model", F.concat(F.lit("v00"), F.substring("model", -1, 1)).alias("model_version"), "roc_auc", "f1")
    return sc.list_models(reg, "v001")


@query(
    "linear_contributions",
    sql_with(
        FIRMS,
        body=" UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'AVG(abs({w}::DOUBLE * ({c} - (SELECT AVG({c}) FROM firms))))')} AS mean_abs_contribution FROM firms" for c, w in (("qty", 0.01), ("avg_disc", -3.0), ("return_rate", 2.0))),
    ),
)
def _linear(spark, sf):
    return sc.linear_contributions(t.firms(spark, sf), {"qty": 0.01, "avg_disc": -3.0, "return_rate": 2.0}).withColumn("mean_abs_contribution", rounded("mean_abs_contribution"))
