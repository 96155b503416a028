import json

import pytest
from pyspark.sql import functions as F

from insolvia.operators import models as md
from insolvia.plans import flows
from insolvia.session import new_path
from insolvia.sources import files as src
from insolvia.sources import landing as ld
from insolvia.sources import payloads as pl
from insolvia.store import files
from insolvia.store import tables as st
from insolvia.streaming import scoring as stream


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_drifting_csvs(spark, tmp_path):
    write(tmp_path / "a.csv", " id ,x\n1,10\n2\n3,30,extra\n")
    write(tmp_path / "b.csv", "id,y\n4,hello\n")
    rows = {(r["id"], r["x"], r["y"], r["_source_file"]) for r in src.read_drifting_csvs(spark, str(tmp_path)).collect()}
    assert rows == {("1", "10", None, "a.csv"), ("2", None, None, "a.csv"), ("4", None, "hello", "b.csv")}


def test_entity_files_go_by_column_name(spark, tmp_path):
    for n in ("aaa.us", "bbb.us"):
        write(tmp_path / f"{n}.csv", "Date,Close\n2020-01-01,1.5\n")
    got = {(r["ticker"], r["Close"]) for r in src.read_entity_csvs(spark, str(tmp_path), types={"Close": "double"}).collect()}
    assert got == {("AAA", 1.5), ("BBB", 1.5)}
    write(tmp_path / "ccc.csv", "Close, Date \n2.5,2020-01-02\n")
    rows = {(r["ticker"], r["Date"], r["Close"]) for r in src.read_entity_csvs(spark, str(tmp_path), types={"Close": "double"}).collect()}
    assert ("CCC", "2020-01-02", 2.5) in rows and ("AAA", "2020-01-01", 1.5) in rows


def test_a_csv_may_be_a_folder_of_part_files(spark, tmp_path):
    write(tmp_path / "aaa.us.csv" / "part-0.csv", "Date,Close\n2020-01-01,1.5\n")
    write(tmp_path / "aaa.us.csv" / "part-1.csv", "Date,Close\n2020-01-02,2.5\n")
    write(tmp_path / "aaa.us.csv" / "_SUCCESS", "")
    write(tmp_path / "file=bbb.us.csv" / "part-0.csv", "Date,Close\n2020-01-01,3.5\n")
    write(tmp_path / "ccc.us.csv", "Close,Date\n4.5,2020-01-01\n")
    got = {(r["ticker"], r["Date"], r["Close"]) for r in src.read_entity_csvs(spark, str(tmp_path), types={"Close": "double"}).collect()}
    assert got == {("AAA", "2020-01-01", 1.5), ("AAA", "2020-01-02", 2.5), ("BBB", "2020-01-01", 3.5), ("CCC", "2020-01-01", 4.5)}
    assert {r["_source_file"] for r in src.read_drifting_csvs(spark, str(tmp_path)).collect()} == {"aaa.us.csv", "bbb.us.csv", "ccc.us.csv"}


def test_parquet_wins_over_csv(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d.parquet"))
    write(tmp_path / "d.csv", "id\n1\n")
    assert src.read_dataset(spark, str(tmp_path), "d").count() == 3
    assert src.discover_datasets(spark, str(tmp_path)) == ["d"]
    with pytest.raises(FileNotFoundError):
        src.read_dataset(spark, str(tmp_path), "none")


def test_payload_files(spark, tmp_path):
    doc = {"entityName": "X", "units": {"USD": [{"val": 1.5, "fy": 2020, "fp": "FY", "form": "10-K", "end": "2020-12-31", "filed": "2021-01-01"}, {"val": None, "end": "bad"}]}}
    write(tmp_path / "p.json", json.dumps(doc))
    docs = pl.read_payloads(spark, str(tmp_path), whole_file=True).select(F.lit(7).alias("cik"), F.lit("Assets").alias("concept"), "payload")
    rows = pl.company_facts(docs).orderBy("value").collect()
    assert [r["value"] for r in rows] == [None, 1.5] and rows[1]["cik"] == "0000000007" and rows[0]["date"] is None


def test_quotes_skip_refusals(spark):
    ok = json.dumps({"Meta Data": {"1. Information": "x"}, "Time Series (Daily)": {"2020-01-02": {"1. open": "1.0", "4. close": "2.0"}}})
    rows = pl.daily_quotes(spark.createDataFrame([("ab", ok), ("cd", '{"Note": "slow down"}')], "symbol string, payload string")).collect()
    assert [(r["symbol"], r["open"], r["close"], r["volume"]) for r in rows] == [("AB", "1.0", "2.0", None)]


def test_indicator_values_that_are_not_numbers(spark):
    doc = json.dumps({"values": {"G": {"USA": {"1999": 1, "2001": "n/a", "2002": 3.5}}}})
    rows = pl.indicator_map(spark.createDataFrame([(doc,)], "payload string"), "2000").collect()
    assert [(r["date"], r["value"]) for r in rows] == [(2001, None), (2002, 3.5)]


def test_tampering_is_noticed(spark):
    root = new_path(spark, "landing")
    manifest = ld.land_all(spark, [ld.Source("s", lambda s: s.range(5).toDF("k"), ["k"]), ld.Source("bad", lambda s: 1 / 0)], root)
    assert {(r["source"], r["status"]) for r in manifest.collect()} == {("s", "success"), ("bad", "failed")}
    assert st.verify_sidecar(spark, f"{root}/metadata", "s")
    spark.range(6).toDF("k").write.mode("overwrite").parquet(f"{root}/interim/s.parquet")
    assert not st.verify_sidecar(spark, f"{root}/metadata", "s")


def test_feature_store_versions_and_verification(spark):
    store = st.FeatureStore(spark, new_path(spark, "store"))
    with pytest.raises(FileNotFoundError):
        store.load()
    df = spark.createDataFrame([("train", 1, 0.5), ("val", 0, 0.25)], "split string, y int, x double")
    assert [store.save(df)["version"] for _ in range(2)] == ["v001", "v002"] and store.latest() == "v002"
    assert store.verify() == {"train": True, "val": True}
    back, record = store.load("v001")
    assert back.count() == 2 and record["splits"]["train"] == {"rows": 1, "cols": 2}


def test_registry_round_trip(spark):
    df = spark.range(60).select(F.col("id").alias("entity_id"), (F.col("id") % 2).cast("int").alias("target"), ((F.col("id") % 2) + F.rand(1)).alias("x"))
    fitted = md.fit("logistic_regression", df, ["x"], "target", {"maxIter": 10})
    reg = st.ModelRegistry(spark, new_path(spark, "models"))
    first = reg.register(fitted, 0.5, {"roc_auc": 0.9}, "v001", "target")
    second = reg.register(fitted, 0.4, {"roc_auc": 0.8}, "v001", "target")
    reg.register_best(first)
    assert (first["model_version"], second["model_version"]) == ("v001", "v002")
    again, meta = reg.load_best()
    assert meta["threshold"] == 0.5 and reg.load("logistic_regression")[1]["model_version"] == "v002"
    a, b = (md.predict(f, df).agg(F.sum("p")).first()[0] for f in (fitted, again))
    assert a == pytest.approx(b)


def prepared_input(spark):
    rows = []
    for i in range(300):
        rows.append((i, i, None if i == 3 else i % 4 == 0, float("inf") if i == 5 else float(i % 17), None if i % 10 == 0 else float(i), "  NA " if i % 50 == 0 else ["a", "b", "c"][i % 3]))
    rows += [(1000 + i, *rows[i][1:]) for i in range(20, 25)]
    df = spark.createDataFrame(rows, "seq long, id long, y boolean, f1 double, f2 double, cat string")
    return df.withColumn("y", F.col("y").cast("int"))


def test_preparation_invariants(spark):
    out, trail, fitted = flows.prepare(prepared_input(spark), "y", "id", "seq")
    steps = {r["step"]: r for r in trail.table(spark).collect()}
    assert steps["cleaning"]["rows_delta"] == -2 and steps["duplicates"]["rows_delta"] == -5 and steps["encoding"]["cols_delta"] == 2
    assert out.count() == 298 and not any(out.filter(F.col(f"`{c}`").isNull()).count() for c in out.columns)
    assert {"cat=a", "cat=b", "cat=c"} <= set(out.columns) and "cat=NA" not in out.columns
    mean = out.filter("split = 'train'").agg(F.avg("f2"), F.stddev_pop("f2")).first()
    assert mean[0] == pytest.approx(0, abs=1e-9) and mean[1] == pytest.approx(1)
    assert set(json.loads(json.dumps(fitted))) == {"impute", "clip", "categories", "scale"}


def test_preparation_with_nearest_neighbours_and_row_filters(spark):
    df = prepared_input(spark).withColumn("f1", F.when(F.col("id") % 60 == 7, 1e6).otherwise(F.col("f1")))
    plain, _, _ = flows.prepare(df, "y", "id", "seq")
    plain = {r["id"]: r["split"] for r in plain.select("id", "split").collect()}
    for clip in ("zscore_rows", "isolation_forest"):
        out, trail, fitted = flows.prepare(df, "y", "id", "seq", impute="nearest", clip=clip)
        got = {r["id"]: r["split"] for r in out.select("id", "split").collect()}
        steps = {r["step"]: r for r in trail.table(spark).collect()}
        lost = {i for i in plain if i not in got}
        assert lost and all(plain[i] == "train" for i in lost) and all(plain[i] == got[i] for i in got)
        assert steps["outliers"]["rows_delta"] == -len(lost) and steps["scaling"]["rows_before"] == steps["outliers"]["rows_after"]
        assert not any(out.filter(F.col(f"`{c}`").isNull()).count() for c in out.columns)
        assert fitted["impute"]["strategy"] == "nearest" and steps["imputation"]["detail"] == "nearest"


def test_stored_splits_that_are_absent_or_unnoted_are_not_ready(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).cast("int").alias("y"))
    df.write.parquet(str(tmp_path / "train.parquet"))
    df.withColumn("y", F.col("y") + F.lit(1)).write.parquet(str(tmp_path / "val.parquet"))
    got = {r["split"]: r for r in flows.check_stored_splits(spark, str(tmp_path), "y", {"train": st.content_hash(df)}).collect()}
    assert got["train"]["ready"] and got["train"]["same_hash"] and got["train"]["n_rows"] == 10
    assert (got["val"]["bad_labels"], got["val"]["same_hash"], got["val"]["ready"]) == (5, False, False)
    assert (got["test"]["n_rows"], got["test"]["ready"]) == (0, False)
    assert flows.check_stored_splits(spark, str(tmp_path / "none"), "y", {}).filter("ready").count() == 0


def test_corpus_survives_a_broken_file(spark, tmp_path):
    spark.createDataFrame([(1, "2020-01-01")], "GDP long, date string").write.parquet(str(tmp_path / "fred.parquet"))
    write(tmp_path / "bad.parquet", "not parquet")
    got = {r["source"]: r for r in flows.validate_corpus(spark, str(tmp_path), "2024-01-01", 2024).collect()}
    assert got["fred"]["grade"] and got["bad"]["load_error"] and got["bad"]["score"] is None


def test_insight_rules_and_order(spark):
    summary = spark.createDataFrame([(6.5, 0, 0.0, 2, 1, 0.01)], "imbalance_ratio double, n_features_with_missing long, overall_missing_pct double, n_highly_skewed long, n_heavy_tailed long, mean_separability double")
    found = flows.insights(summary)
    assert [r["severity"] for r in found.collect()] == ["critical", "warning", "warning", "info"]
    assert "6.5" in flows.headline(found)


def test_stream_windows_close_after_the_watermark(spark, tmp_path):
    folder = tmp_path / "log"
    rows = [("2024-01-01 00:10:00", 10.0, False), ("2024-01-01 00:50:00", 30.0, True), ("2024-01-01 01:30:00", 5.0, False)]
    log = spark.createDataFrame(rows, "ts string, latency_ms double, is_error boolean").select(
        F.to_timestamp("ts").alias("ts"), F.lit("request").alias("kind"), "latency_ms", "is_error", F.lit(0).alias("predictions"), F.lit(0.0).alias("inference_ms")
    )
    log.write.parquet(str(folder))
    out = stream.run_available(stream.windowed_requests(stream.file_stream(spark, str(folder), "*.parquet", log.schema)), "w").collect()
    assert [(r["request_count"], r["error_count"], r["avg_latency_ms"]) for r in out] == [(2, 1, 20.0)]


def test_text_files_replace_atomically(spark):
    path = new_path(spark, "note") + ".json"
    for v in (1, 2):
        files.write_json(spark, path, {"v": v})
    assert files.read_json(spark, path) == {"v": 2} and files.read_json(spark, path + "x", {}) == {}


def test_versions_go_by_number_and_are_never_overwritten(spark, tmp_path):
    for n in (999, 1000):
        spark.createDataFrame([(n, "train")], "x int, split string").write.partitionBy("split").parquet(str(tmp_path / f"v{n}" / "data"))
    store = st.FeatureStore(spark, str(tmp_path))
    assert store.versions() == ["v999", "v1000"] and store.latest() == "v1000"
    record = store.save(spark.createDataFrame([(1, "train"), (2, "val")], "x int, split string"))
    assert record["version"] == "v1001" == store.latest() and store.load()[0].count() == 2
    assert spark.read.parquet(str(tmp_path / "v1000" / "data")).first()["x"] == 1000


def test_hash_tells_where_nulls_stand(spark):
    schema = "a int, b int"
    assert st.content_hash(spark.createDataFrame([(1, None), (None, 2)], schema)) != st.content_hash(spark.createDataFrame([(None, 1), (2, None)], schema))


def test_arrays_of_different_lengths_are_refused(spark, tmp_path):
    df = spark.createDataFrame([([1.0, 2.0], 0, "all"), ([1.0, 2.0, 3.0], 1, "all")], "z array<double>, target int, split string")
    with pytest.raises(ValueError):
        st.export_representation(df, "z", "target", str(tmp_path / "out"))
