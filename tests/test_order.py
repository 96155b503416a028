"""The bounded routes must give the same rows as the plain ones, hot keys and ties included."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from insolvia.operators import order as o
from insolvia.operators import sampling as s
from insolvia.operators import series as se
from insolvia.operators.skew import join_to_keys
from insolvia.session import bounded_collect


def skewed(seed=0, n=600):
    """A third of the rows in one key and a third of the values equal."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.34, "hot", rng.choice(list("abcdefgh"), n))
    value = np.where(rng.random(n) < 0.34, 0.0, np.round(rng.normal(size=n), 2))
    return pd.DataFrame({"id": np.arange(n), "k": key, "t": rng.permutation(n), "v": value})


@pytest.mark.parametrize("probs", [[0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]])
def test_quantiles_by_bracketing(tiny_tasks, probs):
    pdf = skewed()
    pdf.loc[pdf.index % 9 == 0, "t"] = np.nan
    got = o.quantiles(tiny_tasks.createDataFrame(pdf).select("v", F.col("t").cast("double")), ["v", "t"], probs)
    for c in ("v", "t"):
        assert np.allclose(got[c], pdf[c].quantile(probs).to_numpy())


def test_quantiles_plain_route_agrees(spark):
    pdf = skewed(1)
    assert np.allclose(o.quantiles(spark.createDataFrame(pdf), ["v"], [0.1, 0.5])["v"], pdf.v.quantile([0.1, 0.5]))


def test_order_statistics_survive_a_missed_sketch(tiny_tasks, monkeypatch):
    pdf = skewed(2)
    monkeypatch.setattr(o, "SKETCH_ACCURACY", 20)  # wide rank error
    got = o.order_statistics(tiny_tasks.createDataFrame(pdf), {"v": [0, 5, 299, 300, 599]})["v"]
    want = np.sort(pdf.v.to_numpy())
    assert got == {r: want[r] for r in (0, 5, 299, 300, 599)}


def test_many_ranks_take_one_ordered_pass(tiny_tasks):
    pdf = skewed(11)
    got = o.order_statistics(tiny_tasks.createDataFrame(pdf), {"v": list(range(0, 600, 3)), "t": [5]})
    want = np.sort(pdf.v.to_numpy())
    assert got["v"] == {r: want[r] for r in range(0, 600, 3)} and got["t"] == {5: 5}


def test_cuts_split_ties_exactly(tiny_tasks):
    df = tiny_tasks.createDataFrame(skewed(3))
    cuts = o.cut_at(df, ["v", "id"], [0, 1, 200, 333, 600, 900])
    for cut, size in zip(cuts, (0, 1, 200, 333, 600, 600)):
        assert df.filter(cut.condition()).count() == size
    first = {r["id"] for r in df.filter(cuts[3].condition()).collect()}
    assert first == set(skewed(3).sort_values(["v", "id"]).head(333)["id"])


def test_position_is_dense(spark):
    rows = o.with_position(spark.createDataFrame(skewed(4)), ["v", "id"]).toPandas().sort_values("_pos")
    assert rows["_pos"].tolist() == list(range(600))
    assert rows["id"].tolist() == skewed(4).sort_values(["v", "id"])["id"].tolist()


def test_running_totals_in_chunks(tiny_tasks):
    pdf = skewed(5).groupby(["k", "t"], as_index=False).agg(n=("v", "size"))
    got = o.running_totals(tiny_tasks.createDataFrame(pdf), ["k"], ["t"], {"upto": "n"}).toPandas()
    want = pdf.sort_values(["k", "t"]).assign(upto=lambda d: d.groupby("k").n.cumsum())
    merged = got.merge(want, on=["k", "t"])
    assert len(merged) == len(want) and (merged.upto_x == merged.upto_y).all()
    whole = o.running_totals(tiny_tasks.createDataFrame(pdf[["t", "n"]]), [], ["t"], {"upto": "n"}).toPandas().sort_values("t")
    assert whole["upto"].tolist() == list(range(1, 601))


def test_rolling_window_in_chunks_equals_pandas(tiny_tasks):
    pdf = skewed(6)
    got = se.rolling_statistics(tiny_tasks.createDataFrame(pdf), "k", ["t"], ["v"], 7).toPandas()
    assert len(got) == len(pdf)
    want = pdf.sort_values(["k", "t"])
    want["m"] = want.groupby("k").v.transform(lambda x: x.rolling(7, min_periods=1).mean())
    want["s"] = want.groupby("k").v.transform(lambda x: x.rolling(7, min_periods=1).std())
    both = got.merge(want[["id", "m", "s"]], on="id")
    assert np.allclose(both["roll7_mean__v"], both["m"])
    assert np.allclose(both["roll7_std__v"].astype(float), both["s"], equal_nan=True, atol=1e-9)


def test_returns_fill_gaps_forward(tiny_tasks):
    pdf = skewed(7)
    pdf["v"] = np.where(pdf["id"] % 5 == 0, np.nan, pdf["v"] + 10)
    df = tiny_tasks.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = se.period_returns(df, "k", "t", "v").toPandas()
    want = pdf.sort_values(["k", "t"])
    want["r"] = want.groupby("k").v.transform(lambda x: x.ffill().pct_change())
    both = got.merge(want[["id", "r"]], on="id")
    assert len(both) == len(pdf) and np.allclose(both["daily_return"].astype(float), both["r"], equal_nan=True)


def test_grouped_quantile(tiny_tasks):
    pdf = skewed(8)
    counted = tiny_tasks.createDataFrame(pdf).groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {r["k"]: r["quantile"] for r in o.grouped_quantile(counted, ["k"], "v", "n", 0.5).collect()}
    want = pdf.groupby("k").v.median().to_dict()
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_hot_keys_join_apart_from_the_rest(tiny_tasks):
    pdf = skewed(12)
    pdf.loc[pdf.index % 11 == 0, "k"] = "unmatched"
    big = tiny_tasks.createDataFrame(pdf)
    small = big.filter("k <> 'unmatched'").groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("w"))
    assert small.filter("w > 40").count() > 0 and small.filter("w <= 40").count() > 0
    for how in ("inner", "left"):
        got = join_to_keys(big, small, ["k"], "w", how)
        want = big.join(small.drop("w"), ["k"], how)
        assert got.columns == want.columns and got.count() == want.count()
        assert got.select("id", "k", F.round("s", 6)).exceptAll(want.select("id", "k", F.round("s", 6))).count() == 0


def test_entity_statistics_with_a_hot_entity(tiny_tasks):
    pdf = skewed(13)
    got = se.entity_aggregates(tiny_tasks.createDataFrame(pdf), "k", ["v"]).toPandas().sort_values("id")
    assert np.allclose(got["ent_mean__v"], pdf.groupby("k").v.transform("mean")) and np.allclose(got["ent_std__v"], pdf.groupby("k").v.transform("std"))


def test_sample_is_the_smallest_hashes(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    got = {r["k"] for r in o.sample_rows(df, 100, "k").collect()}
    want = {r["k"] for r in df.withColumn("h", o.hash_uniform("k")).orderBy("h", "k").limit(100).collect()}
    assert got == want


def test_stratified_split_keeps_class_mix(tiny_tasks):
    df = tiny_tasks.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    got = {(r["split"], r["y"]): r["count"] for r in s.stratified_split(df, "y", "id").groupBy("split", "y").count().collect()}
    assert got == {("train", 0): 630, ("train", 1): 70, ("val", 0): 135, ("val", 1): 15, ("test", 0): 135, ("test", 1): 15}


def _jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_split_of_many_classes_takes_no_more_jobs(spark):
    few, many = (spark.range(30_000).withColumn("y", F.col("id") % n) for n in (10, 10_000))
    count = lambda df: s.stratified_split(df, "y", "id").groupBy("y", "split").count().toPandas()
    _, jobs_few = _jobs_of(spark, "few", lambda: count(few))
    got, jobs_many = _jobs_of(spark, "many", lambda: count(many))
    assert len(got) == 10_000 and (got["split"] == "train").all() and (got["count"] == 3).all()  # 15 % of three rows round to none
    assert 0 < jobs_many <= jobs_few + 2


def test_class_cuts_equal_plain_ranks_with_repeated_keys_and_null_class(tiny_tasks):
    rng = np.random.default_rng(3)
    y = [None if v == 4 else int(v) for v in rng.integers(0, 5, 900)]
    df = tiny_tasks.createDataFrame([(c, int(k) if k > 100 else 7) for c, k in zip(y, rng.integers(0, 300, 900))], "y int, id long")  # key 7 has a third of all rows
    rows = df.withColumn("h", o.hash_uniform("id", seed=42)).toPandas()
    rows["y"] = rows["y"].fillna(-1)
    want = {}
    for c, part in rows.groupby("y"):
        part = part.sort_values(["h", "id"])
        cut = [int(len(part) * 0.15 + 0.5), 2 * int(len(part) * 0.15 + 0.5)]
        ends = [tuple(part.iloc[n - 1][["h", "id"]]) for n in cut]
        for h, k in zip(part.h, part.id):
            name = "test" if (h, k) <= ends[0] else "val" if (h, k) <= ends[1] else "train"
            want[(c, name)] = want.get((c, name), 0) + 1
    got = {(-1 if r["y"] is None else r["y"], r["split"]): r["count"] for r in s.stratified_split(df, "y", "id").groupBy("y", "split").count().collect()}
    assert got == want


def test_time_split_sizes_and_order(tiny_tasks):
    pdf = skewed(9)
    out = s.time_split(tiny_tasks.createDataFrame(pdf), ["v", "id"]).toPandas()
    sizes = out["split"].value_counts().to_dict()
    assert sizes == {"train": int(int(600 * 0.85) * 0.85), "val": 510 - int(510 * 0.85), "test": 90}
    assert out[out.split == "train"].v.max() <= out[out.split == "val"].v.min()


def test_folds_are_even_and_time_blocks_ordered(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    sizes = [r["count"] for r in s.stratified_folds(df, "y", "id", 5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 2
    blocks = s.expanding_time_folds(df, ["id"], 5).toPandas()
    assert blocks.groupby("block").id.agg(["min", "max"]).shape == (6, 2) and blocks.sort_values("id").block.is_monotonic_increasing
    assert (blocks.block.value_counts().sort_index().to_numpy()[1:] == 103 // 6).all()


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", None)], "seq int, k string, v double")
    last = {(r["k"], r["v"]) for r in s.keep_one(df, ["k"], "seq", "last").collect()}
    assert last == {("a", 2.0), ("b", None)}
    assert {r["v"] for r in s.keep_one(df, ["k"], "seq", "first").collect()} == {1.0, None}


def test_driver_refuses_big_tables(tiny_driver):
    with pytest.raises(ValueError):
        bounded_collect(tiny_driver.range(6))
    assert len(bounded_collect(tiny_driver.range(5))) == 5
