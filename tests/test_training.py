"""Kept fits, folds, the kernel map, training runs that go on after a stop, and stores with several writers."""
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from insolvia.operators import metrics as mt
from insolvia.operators import models as md
from insolvia.operators import neighbors as nb
from insolvia.operators import prepare as pr
from insolvia.operators import sampling
from insolvia.session import new_path
from insolvia.store import files
from insolvia.store import tables as st

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def ring(spark):
    """Positives inside a ring of negatives: no straight line parts them."""
    rng = np.random.default_rng(2)
    angle, inner = rng.uniform(0, 2 * math.pi, 600), np.arange(600) % 3 == 0
    radius = np.where(inner, rng.uniform(0, 1, 600), rng.uniform(2, 3, 600))
    rows = [(int(i), float(r * math.cos(t)), float(r * math.sin(t)), int(k), "train" if i < 360 else "val" if i < 480 else "test") for i, (t, r, k) in enumerate(zip(angle, radius, inner))]
    return spark.createDataFrame(rows, "entity_id long, a double, b double, target int, split string").repartition(3).persist()


def train_of(df):
    return df.filter("split = 'train'")


def auc_of(fitted, df):
    return mt.roc_auc(mt.score_counts(md.predict(fitted, df.filter("split = 'test'")), "target", "p")).first()["roc_auc"]


def test_kernel_machine_parts_a_ring(ring):
    assert auc_of(md.fit("svm", train_of(ring), COLS, "target", {"maxIter": 60}), ring) > 0.98
    assert auc_of(md.fit("logistic_regression", train_of(ring), COLS, "target", {"maxIter": 60}), ring) < 0.8


def test_kernel_map_approaches_the_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    rows = md.with_kernel_map(df, ["a", "b", "c"], {"gamma": 0.4, "count": 4096, "seed": 1}).orderBy("id").collect()
    z = np.array([r["_x"].toArray() for r in rows])
    exact = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.08


def test_scale_width_is_that_of_all_entries(ring):
    x = np.array(train_of(ring).select(*COLS).toPandas())
    assert math.isclose(md.fit_kernel(ring.filter("split = 'train'"), COLS, "scale", 8, 0)["gamma"], 1 / (2 * x.var()), rel_tol=1e-9)


def test_naive_bayes_is_the_gaussian_posterior(ring):
    fitted = md.fit("naive_bayes", train_of(ring), COLS, "target", {"var_smoothing": 1e-3})
    pdf = train_of(ring).toPandas()
    x, y = pdf[COLS].to_numpy(), pdf["target"].to_numpy()
    eps = 1e-3 * x.var(axis=0).max()
    score = [np.log((y == k).mean()) - 0.5 * (np.log(2 * np.pi * (x[y == k].var(axis=0) + eps)) + (x - x[y == k].mean(axis=0)) ** 2 / (x[y == k].var(axis=0) + eps)).sum(axis=1) for k in (0, 1)]
    want = dict(zip(pdf["entity_id"], 1 / (1 + np.exp(score[0] - score[1]))))
    for r in md.predict(fitted, train_of(ring)).collect():
        assert math.isclose(r["p"], want[r["entity_id"]], rel_tol=1e-9, abs_tol=1e-12)


# ---------------------------------------------------------------- folds
def test_time_folds_never_train_on_later_blocks():
    parts = md.fold_parts([3, 0, 2, 1], "time")
    assert parts == [([0], 1), ([0, 1], 2), ([0, 1, 2], 3)]
    assert all(max(some) < one for some, one in parts)
    assert md.fold_parts([0, 1, 2], "shuffled") == [([1, 2], 0), ([0, 2], 1), ([0, 1], 2)]
    with pytest.raises(ValueError):
        md.fold_parts([0, 1], "random")


def test_time_folds_see_only_the_past(ring, monkeypatch):
    """Every fit gets rows older than all rows it is scored on."""
    folds = sampling.expanding_time_folds(train_of(ring), ["entity_id"], 4)
    seen, real = [], md.fit

    def noting(name, train, *rest):
        seen.append((train.agg(F.max("entity_id")).first()[0], train.count()))
        return real(name, train, *rest)

    monkeypatch.setattr(md, "fit", noting)
    out = md.cross_validate("naive_bayes", folds, COLS, "target", "block", kind="time", parallelism=1)
    bounds = [r["m"] for r in folds.groupBy("block").agg(F.min("entity_id").alias("m")).orderBy("block").collect()]
    assert len(out[0]["scores"]) == 4 and [m < b for (m, _), b in zip(seen, bounds[1:])] == [True] * 4
    assert [n for _, n in seen] == sorted(n for _, n in seen)


@pytest.mark.parametrize("name", ["svm", "knn", "naive_bayes", "mlp", "logistic_regression"])
def test_every_algorithm_can_be_searched(ring, name):
    folds = sampling.stratified_folds(train_of(ring), "target", "entity_id", 2)
    small = {"svm": {"maxIter": 5, "kernel_features": 32}, "mlp": {"maxIter": 5}, "logistic_regression": {"maxIter": 5}}.get(name, {})
    grid = [{**small, **c} for c in md.search_grid(name)[:2]]
    rows = md.cross_validate(name, folds, COLS, "target", "fold", grid)
    assert len(rows) == 2 and all(0 <= r["mean"] <= 1 and len(r["scores"]) == 2 for r in rows) and rows[0]["mean"] >= rows[1]["mean"]


def test_search_spaces_cover_the_algorithms():
    assert set(md.SEARCH_SPACES) == set(md.DEFAULTS)
    assert len(md.search_grid("svm")) == 9 and len(md.search_grid("knn")) == 8 and len(md.search_grid("random_forest", method="random", n_iter=4)) == 4


def test_folds_without_a_class_have_no_score(ring):
    df = train_of(ring).withColumn("fold", F.when(F.col("target") == 1, 0).otherwise(F.pmod("entity_id", F.lit(2)) + 1).cast("int"))
    out = md.cross_validate("naive_bayes", df, COLS, "target", "fold")
    assert out[0]["scores"] == [] and math.isnan(out[0]["mean"])


# ---------------------------------------------------------------- kept fits and runs
def test_equal_fits_are_made_once(ring, spark, monkeypatch):
    folder, calls, real = new_path(spark, "fits"), [], md.fit
    monkeypatch.setattr(md, "fit", lambda *a, **k: calls.append(a[0]) or real(*a, **k))
    once = md.fit_once("decision_tree", train_of(ring), COLS, "target", {"maxDepth": 3}, folder=folder)
    again = md.fit_once("decision_tree", train_of(ring).repartition(5), COLS, "target", {"maxDepth": 3}, folder=folder)
    other = md.fit_once("decision_tree", train_of(ring), COLS, "target", {"maxDepth": 2}, folder=folder)
    fewer = md.fit_once("decision_tree", train_of(ring).filter("entity_id > 3"), COLS, "target", {"maxDepth": 3}, folder=folder)
    assert calls == ["decision_tree"] * 3 and other.params["maxDepth"] == 2 and fewer.name == "decision_tree"
    p = [sorted((r["entity_id"], r["p"]) for r in md.predict(f, ring).collect()) for f in (once, again)]
    assert p[0] == p[1]


@pytest.mark.parametrize("name", ["knn", "naive_bayes", "svm", "decision_tree"])
def test_kept_fit_scores_as_before(ring, spark, name):
    fitted = md.fit(name, train_of(ring), COLS, "target", {"maxIter": 5} if name == "svm" else {})
    kept = md.load_fitted(spark, md.save_fitted(fitted, new_path(spark, "fit"), spark))
    a, b = ({r["entity_id"]: r["p"] for r in md.predict(f, ring.filter("split = 'test'")).collect()} for f in (fitted, kept))
    assert len(a) == 120 and all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)


def test_unfinished_fit_is_not_loaded(spark):
    assert md.load_fitted(spark, new_path(spark, "nothing")) is None


def test_run_goes_on_where_it_stopped(ring, spark, monkeypatch):
    folder, fitted, real = new_path(spark, "run"), [], md.train_one
    monkeypatch.setattr(md, "train_one", lambda name, *a, **k: fitted.append(name) or real(name, *a, **k))
    two = {"naive_bayes": {}, "decision_tree": {"maxDepth": -1}}
    first, _ = md.train_all(ring, COLS, "target", "entity_id", two, folder=folder)
    board, models = md.train_all(ring, COLS, "target", "entity_id", {**two, "logistic_regression": {"maxIter": 5}}, folder=folder)
    assert sorted(fitted) == ["decision_tree", "decision_tree", "logistic_regression", "naive_bayes"]  # the failed one is tried again
    rows = {r["model"]: r for r in board.collect()}
    assert rows["decision_tree"]["error"] and set(models) == {"naive_bayes", "logistic_regression"}
    assert rows["naive_bayes"]["roc_auc"] == {r["model"]: r for r in first.collect()}["naive_bayes"]["roc_auc"]


def test_run_with_tuning_folds_and_explanation(ring, spark):
    df = sampling.stratified_folds(ring, "target", "entity_id", 3)
    _, models, records = md.train_run(df, COLS, "target", "entity_id", {"knn": {"k": 3}, "decision_tree": {"maxDepth": 3}}, fold="fold", explain=True)
    assert all(len(r["cv"]["scores"]) == 3 and set(r["importance"]) == set(COLS) and set(r["metrics"]) == {"val", "test"} for r in records)
    reg = st.ModelRegistry(spark, new_path(spark, "models"))
    best = reg.register_run(models, records, "v001", "target")
    fitted, entry = reg.load_best()
    assert entry == best and entry["cv"]["mean"] == records[0 if best["algorithm"] == "knn" else 1]["cv"]["mean"] and fitted.name == best["algorithm"]
    assert {e["algorithm"] for e in reg.entries()} == {"knn", "decision_tree"}


# ---------------------------------------------------------------- several writers
def test_two_writers_lose_nothing(ring, spark):
    root, fitted = new_path(spark, "models"), md.fit("naive_bayes", train_of(ring), COLS, "target")

    def writer(n):
        for _ in range(4):
            st.ModelRegistry(spark, root).register(fitted, 0.5, {"roc_auc": n / 10}, "v001", "target")

    threads = [threading.Thread(target=writer, args=(n,)) for n in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    reg = st.ModelRegistry(spark, root)
    assert sorted(e["model_version"] for e in reg.entries()) == [f"v{i:03d}" for i in range(1, 13)]
    assert sorted(e["metrics"]["roc_auc"] for e in reg.entries()) == [0.0] * 4 + [0.1] * 4 + [0.2] * 4


def test_a_lost_writer_leaves_a_gap(ring, spark):
    reg = st.ModelRegistry(spark, new_path(spark, "models"))
    fitted = md.fit("naive_bayes", train_of(ring), COLS, "target")
    reg._entries.next_number()  # claimed, never written
    assert reg.register(fitted, 0.5, {}, "v001", "target")["model_version"] == "v002" and len(reg.entries()) == 1
    with pytest.raises(FileNotFoundError):
        reg.load_best()


def test_text_is_replaced_in_one_step(spark):
    path = new_path(spark, "pointer") + "/latest.json"
    files.write_text(spark, path, "one")
    files.write_text(spark, path, "two")
    assert files.read_text(spark, path) == "two" and files.names(spark, path.rsplit("/", 1)[0]) == ["latest.json"]


# ---------------------------------------------------------------- NaN
def test_nan_is_filled_like_null(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, "x"), (2, nan, "x"), (3, None, None), (4, 4.0, "y")], "id long, v double, s string")
    for strategy, want in (("median", 2.5), ("mean", 2.5)):
        filled = pr.apply_impute(df, pr.fit_impute(df, ["v"], ["s"], strategy))
        assert [r["v"] for r in filled.orderBy("id").collect()] == [1.0, want, want, 4.0]
        assert [r["s"] for r in filled.orderBy("id").collect()] == ["x", "x", "x", "y"]
    many = spark.createDataFrame([(nan,), (nan,), (nan,), (2.0,)], "v double")
    assert pr.most_frequent(many, ["v"]) == {"v": "2.0"}
    other = df.withColumn("w", F.col("id") * 1.0)
    got = nb.knn_impute(other, other, "id", ["v", "w"], 1).orderBy("id").collect()
    assert [r["v"] for r in got] == [1.0, 1.0, 4.0, 4.0]
    assert sorted(r["v"] for r in pr.clean_simple(df.select("id", "v"), "id").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_nan_is_null_after_clipping_and_scaling(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 4.0), (5, 100.0)], "id long, v double")
    clipped = pr.apply_clip(df, pr.fit_clip(df, ["v"], "iqr_clip")).orderBy("id").collect()
    scaled = pr.apply_scale(df, pr.fit_scale(df, ["v"])).orderBy("id").collect()
    assert [r["v"] is None for r in clipped] == [r["v"] is None for r in scaled] == [False, True, True, False, False]
