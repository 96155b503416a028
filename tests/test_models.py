import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from insolvia.operators import anomaly as an
from insolvia.operators import augment as a
from insolvia.operators import features as ft
from insolvia.operators import metrics as m
from insolvia.operators import models as md
from insolvia.operators import neighbors as nb
from insolvia.operators import prepare as pr


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(0)
    n = 540
    y = (rng.random(n) < 0.2).astype(int)
    pdf = pd.DataFrame({
        "entity_id": np.arange(n), "target": y, "f1": rng.normal(size=n) + 2 * y, "f2": rng.normal(size=n) - 1.5 * y,
        "f3": rng.normal(size=n), "f4": rng.normal(size=n), "split": np.where(np.arange(n) < 300, "train", np.where(np.arange(n) < 420, "val", "test")),
    })
    pdf["copy"] = pdf["f1"] + 1e-3 * rng.normal(size=n)
    pdf["const"] = 1.0
    return spark.createDataFrame(pdf).persist()


FEATURES = ["f1", "f2", "f3", "f4"]
QUICK = {
    "logistic_regression": {"maxIter": 30}, "decision_tree": {"maxDepth": 3}, "random_forest": {"numTrees": 10, "maxDepth": 5}, "boosted_trees": {"maxIter": 5, "maxDepth": 3},
    "naive_bayes": {}, "mlp": {"hidden": (4,), "maxIter": 50}, "svm": {"maxIter": 20}, "knn": {},
}


def train_of(df):
    return df.filter("split = 'train'")


@pytest.mark.parametrize("name", sorted(QUICK))
def test_every_algorithm_finds_the_signal(signal, name):
    fitted = md.fit(name, train_of(signal), FEATURES, "target", QUICK[name])
    scored = md.predict(fitted, signal.filter("split = 'test'"))
    assert scored.count() == 120 and scored.filter("p < 0 or p > 1 or p is null").count() == 0
    assert m.roc_auc(m.score_counts(scored, "target")).first()["roc_auc"] > 0.75


def test_missing_feature_is_an_error(signal):
    fitted = md.fit("logistic_regression", train_of(signal), FEATURES, "target", QUICK["logistic_regression"])
    with pytest.raises(ValueError, match="f1"):
        md.predict(fitted, signal.drop("f1"))


def test_training_run_isolates_a_failure(signal):
    board, models = md.train_all(signal, FEATURES, "target", "entity_id", {"naive_bayes": {}, "decision_tree": {"maxDepth": -1}})
    rows = {r["model"]: r for r in board.collect()}
    assert rows["naive_bayes"]["rank"] == 1 and rows["naive_bayes"]["roc_auc"] > 0.75 and rows["decision_tree"]["error"] and set(models) == {"naive_bayes"}


def test_permutation_importance_ranks_signal_first(signal):
    fitted = md.fit("logistic_regression", train_of(signal), FEATURES, "target", QUICK["logistic_regression"])
    imp = {r["feature"]: r["importance"] for r in md.permutation_importance(fitted, signal.filter("split = 'val'"), "target", "entity_id", 2).collect()}
    assert min(imp["f1"], imp["f2"]) > max(imp["f3"], imp["f4"])


def test_feature_filters(signal):
    cols = FEATURES + ["copy", "const"]
    assert len(ft.correlation_filter(train_of(signal), cols, "target")) == 1
    removed, left = ft.vif_elimination(train_of(signal), cols)
    assert len(removed) == 1 and removed[0] in ("f1", "copy") and max(left.values()) <= 10
    assert {r["feature"] for r in ft.low_variance(train_of(signal), cols).filter("dropped").collect()} == {"const"}
    kept = {r["feature"] for r in ft.vote(ft.voters(train_of(signal), FEATURES, "target", 2)).collect()}
    assert {"f1", "f2"} <= kept
    assert set(md.recursive_elimination(train_of(signal), FEATURES, "target", keep=2)) == {"f1", "f2"}


def test_generated_features_replay_on_held_out_rows(signal):
    plan = ft.plan_features(train_of(signal), FEATURES + ["const"], hints={"skewed_features": ["f1"]})
    train, test = (ft.apply_features(signal.filter(f"split = '{s}'"), plan) for s in ("train", "test"))
    assert train.columns == test.columns and len(plan["generated"]) == len(set(plan["generated"]))
    assert test.filter(" or ".join(f"`{c}` is null" for c in plan["generated"])).count() == 0


def test_projections(signal):
    pca = md.fit_pca(train_of(signal), FEATURES, variance=0.95)
    out = md.apply_projection(train_of(signal), pca).agg(F.avg("pca__1").alias("m")).first()
    assert abs(out["m"]) < 1e-9
    x = np.array(train_of(signal).select(*FEATURES).toPandas())
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    svd = md.fit_svd(train_of(signal), FEATURES, k=2)
    assert np.allclose(np.abs(svd["components"].T @ vt[:2].T), np.eye(2), atol=1e-6)


def test_isolation_forest_finds_planted_rows(spark):
    df = spark.range(1200).select(F.col("id").alias("k"), F.when(F.col("id") < 12, 9.0).otherwise(F.randn(1)).alias("x"), F.when(F.col("id") < 12, -9.0).otherwise(F.randn(2)).alias("z"))
    df = spark.createDataFrame(df.toPandas())
    forest = an.fit_isolation_forest(df, ["x", "z"], "k", trees=40)
    scored = an.anomaly_scores(df, forest).persist()
    worst = {r["k"] for r in scored.orderBy(F.desc("anomaly_score")).limit(12).collect()}
    assert worst == set(range(12))
    cut = an.anomaly_cut(scored, 0.02)
    assert scored.filter(F.col("anomaly_score") > cut).count() == 24
    tagged = df.withColumn("split", F.when(F.col("k") % 2 == 0, "train").otherwise("test"))
    left = {r["split"]: r["count"] for r in an.filter_anomalies(tagged, forest, cut).groupBy("split").count().collect()}
    assert left["test"] == 600 and left["train"] < 600


def test_neighbours_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ref, qry = np.round(rng.normal(size=(300, 3)), 1), np.round(rng.normal(size=(40, 3)), 1)
    mk = lambda x, extra: spark.createDataFrame([(i, [float(v) for v in row], *extra(i)) for i, row in enumerate(x)], "id long, vec array<double>" + (", payload double" if extra(0) else ""))
    monkeypatch.setattr(nb, "QUERY_BLOCK", 16)
    monkeypatch.setattr(nb, "REFERENCE_BLOCK", 50)
    got = nb.nearest(mk(qry, lambda i: ()), mk(ref, lambda i: (float(i % 2),)), 7).toPandas().sort_values(["q_id", "rank"])
    for q, g in got.groupby("q_id"):
        d = np.sqrt(((ref - qry[q]) ** 2).sum(axis=1))
        assert g["r_id"].tolist() == sorted(range(300), key=lambda i: (d[i], i))[:7]


def test_knn_impute_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(60, 3)), 2)
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = nb.knn_impute(df, df, "id", ["a", "b", "c"], 4).toPandas().sort_values("id")[["a", "b", "c"]].to_numpy()
    for i, j in zip(*np.where(np.isnan(x))):
        ds = []
        for r in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[r])
            if not np.isnan(x[r, j]) and both.any():
                ds.append((math.sqrt(((x[i, both] - x[r, both]) ** 2).sum() * 3 / both.sum()), r))
        want = np.mean([x[r, j] for _, r in sorted(ds)[:4]]) if ds else np.nanmean(x[:, j])
        assert math.isclose(got[i, j], want, abs_tol=1e-9)


def test_augmentations_are_repeatable_and_bounded(spark):
    df = spark.range(400).select(F.col("id"), F.array(*[F.lit(1.0)] * 20).alias("x"))
    two = a.views(df, "id", "x", [{"name": "feature_masking", "ratio": 0.25}])
    flat = two.select("id", "view", F.explode("x").alias("v"))
    assert 0.22 < flat.filter("v = 0").count() / flat.count() < 0.28
    wide = two.groupBy("id").pivot("view", [0, 1]).agg(F.first("x"))
    assert wide.filter(F.col("0") != F.col("1")).count() > 390
    assert two.exceptAll(a.views(df.repartition(7), "id", "x", [{"name": "feature_masking", "ratio": 0.25}])).count() == 0
    with pytest.raises(ValueError):
        a.views(df, "id", "x", [{"name": "rotate"}])


def test_partner_is_a_permutation_and_mixup_stays_between(spark):
    df = spark.range(600).select(F.col("id"), F.array(F.col("id").cast("double")).alias("x"))
    paired = a.with_partner(df, "id", ["x"])
    assert paired.count() == 600 and paired.select("_partner.x").distinct().count() == 600
    mixed = a.mixup(df, "id", "x").join(paired.select("id", F.col("_partner.x").alias("o")), "id")
    lo, hi = F.least("id", F.col("o")[0]), F.greatest("id", F.col("o")[0])
    assert mixed.filter((F.col("x")[0] < lo - 1e-9) | (F.col("x")[0] > hi + 1e-9)).count() == 0
    nearer_self = F.abs(F.col("x")[0] - F.col("id")) <= F.abs(F.col("x")[0] - F.col("o")[0]) + 1e-9
    assert mixed.filter(~nearer_self).count() == 0


def test_embedding_statistics_reject_nan(spark):
    good = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "x array<float>")
    row = a.embedding_statistics(good, "x").first()
    assert row["mean_l2_norm"] == 2.5 and row["std_l2_norm"] == 2.5 and row["max"] == 4.0
    with pytest.raises(ValueError):
        a.embedding_statistics(spark.createDataFrame([([float("nan")],)], "x array<float>"), "x")


def test_clip_bounds_come_from_unclipped_train_and_filters_spare_held_out(spark):
    df = spark.range(200).select(F.col("id"), F.when(F.col("id") == 7, 1000.0).otherwise((F.col("id") % 10).cast("double")).alias("x"), F.when(F.col("id") < 100, "train").otherwise("test").alias("split"))
    fitted = pr.fit_clip(train_of(df), ["x"], "zscore_clip", z=2.0)
    row = train_of(df).agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first()
    assert math.isclose(fitted["bounds"]["x"][1], row["m"] + 2 * row["s"])
    far = df.withColumn("x", F.when(F.col("id").isin(7, 150), 1000.0).otherwise(F.col("x")))
    left = pr.apply_zscore_filter(far, pr.fit_zscore_filter(train_of(far), ["x"], 5.0))
    assert {r["id"] for r in far.subtract(left).collect()} == {7}


def test_encoders_and_scalers_on_unseen_and_constant_values(spark):
    train = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 4.0)], "s string, k double, v double")
    test = spark.createDataFrame([("z", 1.0, 3.0), (None, 5.0, 2.0)], "s string, k double, v double")
    fitted = pr.fit_categories(train, ["s"])
    assert [(r["s=a"], r["s=b"]) for r in pr.apply_onehot(test, fitted).collect()] == [(0, 0), (0, 0)]
    assert [r["s"] for r in pr.apply_ordinal(test, fitted).collect()] == [-1.0, -1.0]
    long = pr.fit_categories(train, ["s"], inline=1)
    assert long["categories"] == {} and long["dictionaries"]["s"]["size"] == 2
    assert [r["s"] for r in pr.apply_ordinal(test, long).collect()] == [-1.0, -1.0]
    assert [r["s="].toArray().tolist() for r in pr.apply_onehot(test, long).collect()] == [[0.0, 0.0]] * 2
    for method, want in (("standard", 0.0), ("minmax", 0.0), ("robust", 0.0)):
        scaled = pr.apply_scale(train, pr.fit_scale(train, ["k", "v"], method))
        assert {r["k"] for r in scaled.collect()} == {want}
    assert pr.align_columns(test, ["v", "new"]).columns == ["v", "new"]


def test_model_queries_run_the_operators_defaults(monkeypatch):
    """Every algorithm is on the leaderboard, and no model query makes a fit smaller than models.DEFAULTS."""
    from insolvia.plans import model_queries as mq
    from insolvia.plans.registry import QUERIES

    seen = {}
    note = lambda label, out: lambda *a, **k: seen.__setitem__(label, (a, k)) or out
    monkeypatch.setattr(mq, "scaled_firms", lambda spark, sf: None)
    monkeypatch.setattr(mq, "train_of", lambda df: None)
    monkeypatch.setattr(md, "train_all", note("training_leaderboard", ("board", {})))
    monkeypatch.setattr(md, "combined_importance", note("combined_importance", None))
    monkeypatch.setattr(md, "best_of_two", note("two_model_comparison", None))
    for name in ("training_leaderboard", "combined_importance", "two_model_comparison"):
        QUERIES[name](None, None)
    assert {k: {**md.DEFAULTS[k], **p} for k, p in seen["training_leaderboard"][0][4].items()} == md.DEFAULTS
    assert "trees" not in seen["combined_importance"][1] and seen["two_model_comparison"][0][4:] == ({}, {})


def test_isolation_tree_splits_values_one_step_apart():
    low = 0.05
    x = np.array([[low], [np.nextafter(low, 1)]] * 20)
    for seed in range(20):
        nodes = an.grow(x, np.random.default_rng(seed))
        assert [n[0] for n in nodes].count(-1) == 2 and all(n is not None for n in nodes)


def test_isolation_scores_are_computed_once_and_equal_a_plain_walk(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=900), rng.integers(0, 3, 900), np.ones(900)])
    trees = []
    for rows in (1, 2, 3, 200, 256):
        nodes = an.grow(x[:rows], np.random.default_rng(rows))
        trees.append(tuple(np.array([n[c] for n in nodes]) for c in range(5)))
    monkeypatch.setattr(an, "SCORED", 128)
    got = an.path_lengths(x, [an.laid_out(t) for t in trees])
    for row, value in zip(x, got):
        want = 0.0
        for feature, cut, left, right, length in trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] <= cut[at] else right[at]
            want += length[at]
        assert value == want
    read = []
    cut_of = an.anomaly_cut
    monkeypatch.setattr(an, "anomaly_cut", lambda scored, *a: read.extend(scored.inputFiles()) or cut_of(scored, *a))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double, c double")
    row = an.anomaly_summary(df, ["a", "b", "c"], "k", trees=10, contamination=0.1).first()
    assert read and all("anomaly-scores" in f for f in read)
    assert row["n_rows"] == 900 and 80 <= row["n_anomalies"] <= 90
