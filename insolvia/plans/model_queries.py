"""Fits, tuning, importances, projections, anomalies and whole training flows on the firms.

Model fits have no SQL equal; they are checked by row counts and by the tests.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import anomaly as an
from ..operators import metrics as mt
from ..operators import models as md
from ..operators import prepare as p
from ..operators import sampling, scoring
from ..session import new_path
from ..store import tables as st
from . import tables as t
from .registry import query
from .tables import FEATURES, FIRMS, r, sql_with

# Every algorithm as the operator fits it: models.DEFAULTS, nothing overridden.
ALGORITHMS: dict[str, dict] = {name: {} for name in md.DEFAULTS}


def scaled_firms(spark, sf):
    """Winsorized and standardised on train, all splits."""

    def build(s, d):
        df = t.firms(s, d)
        df = p.apply_clip(df, p.fit_clip(df.filter(F.col("split") == "train"), FEATURES))
        return p.apply_scale(df, p.fit_scale(df.filter(F.col("split") == "train"), FEATURES))

    return t.stored(spark, sf, "scaled_firms", build)


def train_of(df):
    return df.filter(F.col("split") == "train")


@query("risk_scoring")
def _flagship(spark, sf):
    df = scaled_firms(spark, sf)
    fitted = md.fit("logistic_regression", train_of(df), FEATURES, "target")
    scored = md.predict(fitted, df)
    threshold, _ = mt.choose_threshold(mt.score_counts(scored.filter(F.col("split") == "val"), "target", "p"))
    return scoring.score(scored, "p", threshold, "v001", "logistic_regression", F.lit("2024-01-20T00:00:00"), key="entity_id")


_per = lambda f: ", ".join(f(c) for c in FEATURES)
# The winsorized and standardised firms in SQL.
SCALED = (
    FIRMS
    + f""", bounds AS (SELECT {_per(lambda c: f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}")} FROM firms WHERE split = 'train'),
  cut AS (SELECT entity_id, target, split, {_per(lambda c: f"least(greatest({c}, lo_{c}), hi_{c}) AS {c}")} FROM firms, bounds),
  moments AS (SELECT {_per(lambda c: f"AVG({c}) AS m_{c}, stddev_pop({c}) AS s_{c}")} FROM cut WHERE split = 'train'),
  scaled AS (SELECT entity_id, target, split, {_per(lambda c: f"({c} - m_{c}) / s_{c} AS {c}")} FROM cut, moments)"""
)
_density = lambda k: f"ln((SELECT COUNT(*) FILTER (WHERE target = {k}) / COUNT(*)::DOUBLE FROM scaled WHERE split = 'train'))" + "".join(
    f" - 0.5 * ln(2 * pi() * (v{k}_{c} + e)) - ({c} - m{k}_{c}) ** 2 / (2 * (v{k}_{c} + e))" for c in FEATURES
)
EXACT = {
    "naive_bayes": sql_with(
        SCALED,
        f"smooth AS (SELECT 1e-9 * greatest({_per(lambda c: f'var_pop({c})')}) AS e FROM scaled WHERE split = 'train')",
        "classes AS (SELECT " + _per(lambda c: ", ".join(f"AVG({c}) FILTER (WHERE target = {k}) AS m{k}_{c}, var_pop({c}) FILTER (WHERE target = {k}) AS v{k}_{c}" for k in (0, 1))) + " FROM scaled WHERE split = 'train')",
        body=f"SELECT entity_id, target, {r(f'1 / (1 + exp(({_density(0)}) - ({_density(1)})))')} AS p FROM scaled, smooth, classes WHERE split = 'test'",
    ),
    "knn": sql_with(
        SCALED,
        "d AS (SELECT a.entity_id, a.target, b.entity_id AS near, b.target AS vote, sqrt(" + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in FEATURES) + ") AS d FROM scaled a, scaled b WHERE a.split = 'test' AND b.split = 'train')",
        "best AS (SELECT * FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY d, near) <= 15)",
        body=f"SELECT entity_id, target, {r('CASE WHEN COUNT(*) FILTER (WHERE d = 0) > 0 THEN AVG(vote) FILTER (WHERE d = 0) ELSE SUM(vote / d) FILTER (WHERE d > 0) / SUM(1 / d) FILTER (WHERE d > 0) END')} AS p FROM best GROUP BY entity_id, target",
    ),
}

for _name, _params in ALGORITHMS.items():

    @query(f"fit_{_name}", EXACT.get(_name))
    def _fit(spark, sf, name=_name, params=_params):
        df = scaled_firms(spark, sf)
        scored = md.predict(md.fit_once(name, train_of(df), FEATURES, "target", params), df.filter(F.col("split") == "test"))
        return scored.select("entity_id", "target", rounded("p").alias("p"))


@query("fold_scores")
def _cv(spark, sf):
    folds = sampling.stratified_folds(train_of(scaled_firms(spark, sf)), "target", "entity_id", 5)
    rows = md.cross_validate("logistic_regression", folds, FEATURES, "target", "fold")
    return spark.createDataFrame([(x["mean"], x["std"]) for x in rows], "mean double, std double")


@query("fold_scores_over_time")
def _time_cv(spark, sf):
    folds = sampling.expanding_time_folds(train_of(scaled_firms(spark, sf)), ["entity_id"], 5)
    rows = md.cross_validate("naive_bayes", folds, FEATURES, "target", "block", kind="time")
    return spark.createDataFrame([(x["mean"], x["std"], len(x["scores"])) for x in rows], "mean double, std double, n_folds int")


def _searched(spark, sf, name):
    folds = sampling.stratified_folds(train_of(scaled_firms(spark, sf)), "target", "entity_id", 3)
    rows = md.cross_validate(name, folds, FEATURES, "target", "fold", md.search_grid(name))
    return spark.createDataFrame([(str(sorted(x["params"].items())), x["mean"], x["std"]) for x in rows], "params string, mean double, std double")


@query("parameter_search")
def _search(spark, sf):
    return _searched(spark, sf, "decision_tree")


for _name in ("logistic_regression", "naive_bayes", "knn"):

    @query(f"parameter_search_{_name}")
    def _search_one(spark, sf, name=_name):
        return _searched(spark, sf, name)


@query("native_importance")
def _native(spark, sf):
    df = scaled_firms(spark, sf)
    return md.importance_table(df, md.native_importance(md.fit_once("random_forest", train_of(df), FEATURES, "target")))


@query("permutation_importance")
def _permutation(spark, sf):
    df = scaled_firms(spark, sf)
    fitted = md.fit("logistic_regression", train_of(df), FEATURES, "target")
    return md.permutation_importance(fitted, df.filter(F.col("split") == "val"), "target", "entity_id")


@query("combined_importance")
def _combined(spark, sf):
    return md.combined_importance(train_of(scaled_firms(spark, sf)), FEATURES, "target")


@query(
    "mean_importance_rank",
    sql_with(
        FIRMS,
        "s AS (SELECT feature, method, score FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, target)) AS a, stddev_samp({c}) AS b, 0.0::DOUBLE + COUNT(DISTINCT target) AS c FROM firms" for c in FEATURES) + ") UNPIVOT (score FOR method IN (a, b, c)))",
        body=f"SELECT feature, {r('AVG(rk)')} AS mean_rank FROM (SELECT feature, rank() OVER (PARTITION BY method ORDER BY score DESC) + (COUNT(*) OVER (PARTITION BY method, score) - 1) / 2.0::DOUBLE AS rk FROM s) GROUP BY feature",
    ),
)
def _mean_rank(spark, sf):
    from ..operators import relations as rel

    df = t.firms(spark, sf)
    corr = rel.correlation_with(df, "target", FEATURES).select("feature", F.abs("r").alias("a"))
    from ..operators.features import variances

    spread = variances(df, FEATURES).select("feature", F.sqrt("variance").alias("b"))
    wide = corr.join(spread, "feature").withColumn("c", F.lit(2.0))
    return md.mean_rank(wide, ["a", "b", "c"]).withColumn("mean_rank", rounded("mean_rank"))


@query("recursive_elimination")
def _rfe(spark, sf):
    kept = md.recursive_elimination(train_of(scaled_firms(spark, sf)), FEATURES, "target", keep=3)
    return spark.createDataFrame([(c, c in kept) for c in FEATURES], "feature string, kept boolean")


@query("forest_selection")
def _select(spark, sf):
    kept = md.select_by_forest(train_of(scaled_firms(spark, sf)), FEATURES, "target")
    return spark.createDataFrame([(c, c in kept) for c in FEATURES], "feature string, kept boolean")


@query("pca_explained_variance")
def _variance(spark, sf):
    return md.explained_variance(t.firms(spark, sf), FEATURES)[0]


@query("pca_projection")
def _projection(spark, sf):
    out = md.standardised_projection(t.firms(spark, sf), FEATURES, 2)
    return out.select("entity_id", "target", rounded("pca__1", 4).alias("pc1"), rounded("pca__2", 4).alias("pc2"))


TWO = ["gross", "avg_disc"]
Z = "z AS (SELECT entity_id, (gross - AVG(gross) OVER ()) / stddev_pop(gross) OVER () AS a, (avg_disc - AVG(avg_disc) OVER ()) / stddev_pop(avg_disc) OVER () AS b FROM firms), c AS (SELECT corr(a, b) AS r FROM z)"


@query(
    "pca_variance_of_two",
    sql_with(FIRMS, Z, body=f"SELECT 'PC1' AS component, {r('(1 + abs(r)) / 2')} AS explained_variance_ratio, {r('(1 + abs(r)) / 2')} AS cumulative_variance FROM c UNION ALL SELECT 'PC2', {r('(1 - abs(r)) / 2')}, 1.0::DOUBLE FROM c"),
)
def _two_variance(spark, sf):
    out = md.explained_variance(t.firms(spark, sf), TWO)[0]
    return out.withColumns({c: rounded(c) for c in ("explained_variance_ratio", "cumulative_variance")})


@query(
    "pca_scores_of_two",
    sql_with(FIRMS, Z, body=f"SELECT entity_id, {r('abs(a + sign(r) * b) / sqrt(2)', 4)} AS pc1, {r('abs(a - sign(r) * b) / sqrt(2)', 4)} AS pc2 FROM z, c"),
)
def _two_scores(spark, sf):
    # a component's sign is arbitrary, so magnitudes are compared
    out = md.standardised_projection(t.firms(spark, sf), TWO, 2)
    return out.select("entity_id", rounded(F.abs("pca__1"), 4).alias("pc1"), rounded(F.abs("pca__2"), 4).alias("pc2"))


@query("pca_features")
def _pca(spark, sf):
    df = scaled_firms(spark, sf)
    return md.apply_projection(df, md.fit_pca(train_of(df), FEATURES, variance=0.95))


@query("svd_features")
def _svd(spark, sf):
    df = scaled_firms(spark, sf)
    return md.apply_projection(df, md.fit_svd(train_of(df), FEATURES), mode="replace")


@query("isolation_forest_share")
def _iforest(spark, sf):
    return an.anomaly_summary(t.firms(spark, sf), FEATURES, "entity_id", trees=100)


@query("isolation_forest_summary")
def _isummary(spark, sf):
    return an.anomaly_summary(t.table(spark, sf, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "k", trees=200, contamination=0.05)


@query("isolation_forest_filter")
def _ifilter(spark, sf):
    df = t.firms(spark, sf)
    forest = an.fit_isolation_forest(train_of(df), FEATURES, "entity_id", 100)
    cut = an.anomaly_cut(an.anomaly_scores(train_of(df), forest), 0.02)
    return an.filter_anomalies(df, forest, cut).groupBy("split").agg(F.count("*").alias("n_rows"))


@query("training_leaderboard")
def _train_all(spark, sf):
    board, _ = md.train_all(scaled_firms(spark, sf), FEATURES, "target", "entity_id", ALGORITHMS)
    return board


@query(
    "training_contract",
    sql_with(FIRMS, body="SELECT unnest(['" + "', '".join(ALGORITHMS) + "']) AS model, FALSE AS failed, TRUE AS metrics_in_range, (SELECT COUNT(*) FROM firms WHERE split = 'test') AS n_scored"),
)
def _train_contract(spark, sf):
    """What any run must hold: every algorithm trained, all metrics within their range, every test row scored."""
    df = scaled_firms(spark, sf)
    board, models = md.train_all(df, FEATURES, "target", "entity_id", ALGORITHMS)
    fine = F.lit(True)
    for c in md.BOARD_METRICS:
        fine = fine & F.coalesce(F.col(c).between(-1.0 if c == "mcc" else 0.0, 1.0), F.lit(False))
    counts = None
    for name, fitted in models.items():
        scored = md.predict(fitted, df.filter("split = 'test'")).agg(F.count_if(F.col("p").between(0, 1)).alias("n_scored")).withColumn("model", F.lit(name))
        counts = scored if counts is None else counts.unionByName(scored)
    return board.select("model", F.col("error").isNotNull().alias("failed"), fine.alias("metrics_in_range")).join(counts, "model", "left")


@query("training_registry")
def _train_registry(spark, sf):
    """Tuning, folds, explanation and registry entry of the quick algorithms."""
    df = sampling.stratified_folds(scaled_firms(spark, sf), "target", "entity_id", 3)
    quick = {n: {} for n in ("logistic_regression", "naive_bayes")}
    _, models, records = md.train_run(df, FEATURES, "target", "entity_id", quick, fold="fold", search="grid", explain=True)
    reg = st.ModelRegistry(spark, new_path(spark, "models"))
    best = reg.register_run(models, records, "v001", "target")
    rows = [(e["algorithm"], e["model_version"] == best["model_version"], e["cv"]["mean"], str(sorted(e["tuning"]["best_params"].items())), e["metrics"]["roc_auc"], e["val_metrics"]["roc_auc"], next(iter(e["importance"]))) for e in reg.entries()]
    return spark.createDataFrame(rows, "algorithm string, is_best boolean, cv_mean double, best_params string, test_roc_auc double, val_roc_auc double, top_feature string")


@query("two_model_comparison")
def _two(spark, sf):
    return md.best_of_two(scaled_firms(spark, sf), FEATURES, "target", "entity_id", ALGORITHMS["random_forest"], ALGORITHMS["boosted_trees"])
