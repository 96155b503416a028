"""Grown trees: equal to Spark ML's where nothing is drawn, few jobs, the same on any layout, kept and read back."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import classification as mlc

from insolvia.operators import models as md
from insolvia.operators import trees as tr

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 700
    y = (rng.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame({"entity_id": np.arange(n), "target": y, "a": rng.normal(size=n) + y, "b": np.round(rng.normal(size=n) - y, 1), "c": rng.integers(0, 4, n).astype(float)})
    return spark.createDataFrame(pdf).repartition(3).persist()


def scores(fitted, df):
    return {r["entity_id"]: r["p"] for r in md.predict(fitted, df).collect()}


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_boosting_equals_spark_where_nothing_is_drawn(rows):
    params = {"maxIter": 12, "maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 1.0}
    fitted = md.fit("boosted_trees", rows, FEATURES, "target", params)
    weighted = md.assembler(FEATURES).transform(md.with_class_weight(rows, "target", "positive"))
    model = mlc.GBTClassifier(featuresCol="_x", labelCol="target", weightCol="_w", seed=42, **params).fit(weighted)
    want = {r["entity_id"]: r["probability"][1] for r in model.transform(weighted).select("entity_id", "probability").collect()}
    got = scores(fitted, rows)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6
    assert np.allclose([md.native_importance(fitted)[c] for c in FEATURES], model.featureImportances.toArray(), atol=1e-6)


def test_a_tree_of_all_rows_and_features_equals_spark(rows, monkeypatch):
    class Whole(np.random.Generator):
        def poisson(self, lam, size):
            return np.ones(size)

    monkeypatch.setattr(tr.np.random, "default_rng", lambda seed: Whole(np.random.PCG64(seed)))
    pdf = rows.toPandas()
    weights = md.class_weights({k: int((pdf["target"] == k).sum()) for k in (0, 1)})
    scale, label = np.array(weights), pdf["target"].to_numpy(np.uint8)
    cuts = [tr.cuts_of(pdf[c].to_numpy(), scale[label], 31) for c in FEATURES]
    flat = np.column_stack([np.searchsorted(cut, pdf[c].to_numpy()) for c, cut in zip(FEATURES, cuts)]).astype(np.uint8).ravel()
    tree = tr.grow_classifier(flat, 3, label, np.arange(3), 3, scale, 4, 4, tr.np.random.default_rng(1))
    weighted = md.assembler(FEATURES).transform(md.with_class_weight(rows, "target"))
    model = mlc.DecisionTreeClassifier(featuresCol="_x", labelCol="target", weightCol="_w", maxDepth=4, minInstancesPerNode=4).fit(weighted)
    want = {r["entity_id"]: r["probability"][1] for r in model.transform(weighted).select("entity_id", "probability").collect()}
    assert len(tree["feature"]) == model.numNodes
    for i, key in enumerate(pdf["entity_id"]):
        at = 0
        while tree["feature"][at] >= 0:
            at = tree["child"][at] + (flat[3 * i + tree["feature"][at]] > tree["bin"][at])
        assert abs(tree["value"][at] - want[key]) < 1e-9


@pytest.mark.parametrize("name,params", [("random_forest", {"numTrees": 30, "maxDepth": 12}), ("boosted_trees", {"maxIter": 30, "maxDepth": 4})])
def test_a_fit_takes_few_jobs_and_repeats_on_another_layout(spark, rows, name, params):
    fitted, jobs = jobs_of(spark, f"fit-{name}", lambda: md.fit(name, rows, FEATURES, "target", params))
    assert 0 < jobs < 25
    other = md.fit(name, rows.orderBy("b").repartition(5), FEATURES, "target", params)
    one, two = scores(fitted, rows), scores(other, rows)
    assert max(abs(one[k] - two[k]) for k in one) < 1e-12 and md.native_importance(fitted) == md.native_importance(other)
    y = {r["entity_id"]: r["target"] for r in rows.collect()}
    assert np.mean([one[k] for k in y if y[k]]) > np.mean([one[k] for k in y if not y[k]]) + 0.2


def test_rows_in_small_portions_grow_the_same_trees(spark, rows, monkeypatch):
    pdf = rows.toPandas()
    label = np.sort(pdf["target"].to_numpy(np.uint8))
    columns = [np.random.default_rng(i).integers(0, 32, len(label)).astype(np.uint8) for i in range(3)]
    flat, scale = np.column_stack(columns).ravel(), np.array([1.0, 2.0])
    turn, sign = int(np.searchsorted(label, 1)), np.where(label == 1, 1.0, -1.0)
    grow = lambda: (tr.grow_classifier(flat, 3, label, np.arange(3), 2, scale, 9, 2, np.random.default_rng(5)), tr.grow_regressor(columns, turn, scale[label] * sign, scale, np.arange(len(label)), 4, 1)[0])
    whole = grow()
    monkeypatch.setattr(tr, "ROWS", 64)
    monkeypatch.setattr(tr, "CELLS", 2 * tr.BINS * 3)
    for a, b in zip(whole, grow()):
        assert all(np.allclose(a[k], b[k]) for k in a)


def test_kept_trees_score_alike_and_gaps_are_an_error(spark, rows, tmp_path):
    fitted = md.fit("random_forest", rows, FEATURES, "target", {"numTrees": 5, "maxDepth": 4})
    md.save_fitted(fitted, f"{tmp_path}/kept", spark)
    again = md.load_fitted(spark, md.save_fitted(md.load_fitted(spark, f"{tmp_path}/kept"), f"{tmp_path}/copy", spark))
    assert again.numbers["trees"] == f"{tmp_path}/copy/trees" and scores(fitted, rows) == scores(again, rows)
    broken = rows.selectExpr("entity_id", "target", "a", "if(entity_id = 5, null, b) AS b", "c")
    with pytest.raises(Exception, match="null"):
        md.predict(fitted, broken).collect()
    with pytest.raises(Exception, match="null"):
        md.fit("random_forest", broken, FEATURES, "target", {"numTrees": 2, "maxDepth": 2})


def test_tables_beyond_a_task_go_through_spark_ml(rows, monkeypatch):
    monkeypatch.setattr(tr, "MATRIX_BYTES", 1_000)
    fitted = md.fit("random_forest", rows, FEATURES, "target", {"numTrees": 3, "maxDepth": 3})
    assert fitted.model is not None and "trees" not in fitted.numbers
