"""The whole feature run with its replayable document, and the exploration report."""
import json
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from insolvia.operators import features as ft
from insolvia.plans import exploration, featurerun, flows
from insolvia.session import new_path
from insolvia.store.tables import FeatureStore

QUICK = featurerun.Settings(base=3, forest_trees=5, importance_trees=3, top_k=8)
LIGHT = featurerun.Settings(base=3, forest_trees=None, importance_trees=None)


@pytest.fixture(scope="module")
def firms(spark):
    """200 rows: a tells the target, b follows a, c is noise with many equal values, flat never changes."""
    k = F.col("id")
    noise = lambda salt: (F.crc32(F.concat(k.cast("string"), F.lit(salt))) % 1000) / 1000.0
    df = spark.range(200).select(
        k.alias("firm"), F.lit("x").alias("name"), (k % 2).cast("int").alias("target"),
        F.when(k < 140, "train").when(k < 170, "val").otherwise("test").alias("split"),
        ((k % 2) * 2 + noise("a")).alias("a"), ((k % 2) * 4 + 2 * noise("a") + 0.001 * noise("b")).alias("b"), F.when(k % 9 != 0, noise("c") + 1).alias("c"),
        (noise("d") * 5 + 1).alias("d"), F.lit(3.0).alias("flat"),
    )
    return df.fillna({"c": 1.5})


def test_document_replays_what_was_stored(spark, firms):
    store = FeatureStore(spark, new_path(spark, "store"))
    rows, record = featurerun.run_features(firms, "target", ["firm"], store, settings=QUICK)
    state = record["state"]
    assert state == json.loads(json.dumps(state))
    assert record["features"] == state["features"] and record["splits"]["train"]["rows"] == 140
    again = featurerun.replay_version(firms.withColumn("more", F.lit(1)), store)
    assert set(again.columns) == {"firm", "target", "split", *state["features"]}
    ours, theirs = ({r["firm"]: r.asDict() for r in d.collect()} for d in (rows, again))
    assert ours == theirs and len(ours) == 200
    assert all(v is not None and not math.isnan(v) for r in ours.values() for c, v in r.items() if c in state["features"])
    assert [t[0] for t in state["trail"]] == ["generation", "multicollinearity", "selection", "reduction", "importance"]
    assert featurerun.lineage(spark, state).count() == 5
    scored = featurerun.importance(spark, state).collect()
    assert {r["feature"] for r in scored} == set(state["features"])
    assert math.isclose(sum(r["random_forest"] for r in scored), 1.0, rel_tol=1e-9)


def test_replay_takes_rows_without_target_or_split_and_refuses_lost_columns(spark, firms):
    state = featurerun.fit_features(firms, "target", ["firm"], settings=LIGHT)
    out = featurerun.replay(firms.drop("target", "split"), state)
    assert out.columns == ["firm", *state["features"]] and out.count() == 200
    assert featurerun.replay(firms.limit(0), state).count() == 0
    with pytest.raises(ValueError, match="missing model features"):
        featurerun.replay(firms.drop("a"), state)


def test_fitted_on_train_alone(spark, firms):
    state = featurerun.fit_features(firms, "target", ["firm"], settings=LIGHT)
    shifted = firms.withColumn("c", F.when(F.col("split") == "train", F.col("c")).otherwise(F.col("c") * 100))
    other = featurerun.fit_features(shifted, "target", ["firm"], settings=LIGHT)
    assert (other["plan"], other["removed"], other["selected"]) == (state["plan"], state["removed"], state["selected"])


def test_stages_are_left_out_and_replaced(spark, firms):
    bare = featurerun.Settings(base=2, correlation=None, inflation=None, variance=None, min_votes=None, eliminate_to=None, forest_trees=None, reduction=None, importance_trees=None)
    state = featurerun.fit_features(firms, "target", ["firm"], settings=bare)
    assert state["features"] == state["sources"] + state["plan"]["generated"] and state["removed"] == {}
    components = replace(LIGHT, reduction="svd", mode="replace")
    state = featurerun.fit_features(firms, "target", ["firm"], settings=components)
    assert state["features"] == [f"svd__{i + 1}" for i in range(len(state["features"]))]


def test_a_run_needs_train_rows_and_two_features(spark, firms):
    with pytest.raises(ValueError, match="train rows"):
        featurerun.fit_features(firms.filter("split <> 'train'"), "target", ["firm"])
    with pytest.raises(ValueError, match="two numeric"):
        featurerun.fit_features(firms.select("firm", "target", "split", "a"), "target", ["firm"])


def test_pairs_without_a_limit(spark, firms):
    names = [f"x{i}" for i in range(20)]
    assert len(ft.pair_plan(names, None)) == 190 and len(ft.pair_plan(names, 30)) == 30
    plan = ft.plan_features(firms, ["a", "b", "c", "d", "flat"], limits=(None, 1, 0))
    assert (len(plan["ratio"]), len(plan["interaction"]), len(plan["difference"])) == (10, 1, 0)


def test_report_is_read_back_and_a_failed_analyzer_stays_in_it(spark, firms, monkeypatch):
    def fails(df, cols, target, key):
        raise ValueError("no such thing")

    monkeypatch.setitem(flows.ANALYZERS, "broken", fails)
    folder = new_path(spark, "report")
    only = ["target", "missing", "broken", "distributions", "correlation", "ratios", "relationships", "dimensionality"]
    said = exploration.write_report(firms.drop("split"), "target", "firm", folder, only=only)
    assert exploration.load_report(spark, folder) == json.loads(json.dumps(said))
    assert said["meta"]["n_run"] == 7 and said["meta"]["n_failed"] == 1
    broken = next(a for a in said["analyzers"] if a["analyzer"] == "broken")
    assert broken["status"] == "failed" and "no such thing" in broken["error"] and broken["table"] is None
    assert spark.read.option("header", True).csv(said["analyzers"][0]["table"]).count() == 1
    hints = exploration.load_hints(spark, folder)
    assert hints["top_discriminative"][0] in ("a", "b") and ["a", "b"] == hints["high_correlation_pairs"][0][:2]
    kinds = {i["category"] for i in said["insights"]["items"]}
    assert {"multicollinearity", "predictive_power", "data_quality"} <= kinds
    assert (said["summary"]["n_components_95pct"], said["summary"]["n_features"]) == (3, 5)  # a and b share one, flat has none
    assert said["insights"]["headline"] == "1 correlated pairs, 0 features with high inflation"


def test_no_report_gives_no_hints(spark):
    assert exploration.load_hints(spark, new_path(spark, "none")) == {}
