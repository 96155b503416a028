import math

import pytest
from pyspark.sql import functions as F

from insolvia.functions.contracts import Contract, contract_for
from insolvia.functions.scalars import clean_text, confidence, risk_band, risk_score, safe_ratio, to_number
from insolvia.operators import quality as q
from insolvia.plans.crosscheck import cross_check, cross_summary
from insolvia.session import new_path
from insolvia.store.tables import write_sidecar


def one(df):
    return df.first().asDict()


def test_schema_contract_findings(spark):
    c = Contract("s", required={"id": "string", "value": "numeric"})
    assert one(q.schema_metrics(spark.createDataFrame([("a",)], "id string"), c))["missing_required"] == "value"
    row = one(q.schema_metrics(spark.createDataFrame([("a", 1.0, 1)], "id string, value double, surprise int"), c))
    assert row["unexpected"] == "surprise" and row["schema_score"] == 1.0
    row = one(q.schema_metrics(spark.createDataFrame([("a", "text")], "id string, value string"), c))
    assert row["dtype_mismatch"] == "value" and math.isclose(row["schema_score"], 1 - 0.25 / 2)


def test_text_dates_count_as_datetime_from_90_percent(spark):
    c = Contract("s", required={"d": "datetime"})
    good = spark.createDataFrame([("2020-01-01",)] * 9 + [("x",)], "d string")
    bad = spark.createDataFrame([("2020-01-01",)] * 8 + [("x",)] * 2, "d string")
    assert q.kind_matches(good, c)["d"] and not q.kind_matches(bad, c)["d"]


def test_missing(spark):
    df = spark.createDataFrame([(None,)] * 9 + [(1.0,)], "value double")
    assert one(q.missing_metrics(df, ["value"]))["required_mostly_missing"] == 1
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (3.0,)], "a double")
    assert one(q.missing_metrics(df))["completeness_score"] == 0.75


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a long, b string")
    assert one(q.duplicate_rows(df))["duplicate_rows"] == 1
    df = spark.createDataFrame([("e", "2020-01-01", 1), ("e", "2020-01-01", 2), ("f", "2020-01-01", 3)], "eid string, date string, v long")
    assert one(q.natural_key_duplicates(df, Contract("s", entity="eid", dates=("date",))))["count"] == 1


def test_injected_outliers_are_flagged(spark):
    df = spark.range(240).select(F.when(F.col("id") < 200, F.randn(3)).otherwise(1000.0).alias("x"))
    assert one(q.iqr_outliers(df, ["x"]))["pct"] > 0.10


def test_constant_and_short_columns_are_left_out(spark):
    df = spark.range(30).select(F.lit(1.0).alias("c"), F.col("id").cast("double").alias("x"))
    assert [r["feature"] for r in q.iqr_outliers(df, ["c", "x"]).collect()] == ["x"]
    assert q.outlier_columns(df) == ["x"]


def test_rules_fire(spark):
    c = Contract("s", dates=("date",), years=("fy",), nonneg=("revenue",), positive=("assets",), fiscal_year="fy")
    df = spark.createDataFrame([(-1.0, 0.0, "2025-01-01", 2020), (1.0, 5.0, "2023-01-01", 1800), (2.0, 1.0, "2023-01-02", 3000)], "revenue double, assets double, date string, fy int")
    got = {r["code"]: r["count"] for r in q.value_rules(df, c, "2024-01-01", 2024).collect()}
    assert got == {"negative_value": 1, "nonpositive_value": 1, "invalid_fiscal_year": 2, "future_date": 1, "future_year": 1}
    assert one(q.validity_metrics(q.value_rules(df, c, "2024-01-01", 2024)))["invalid_rows"] == 3


def test_concept_rules(spark):
    df = spark.createDataFrame([("Assets", 0.0), ("Assets", 1.0), ("Revenues", -1.0), ("Other", -5.0)], "concept string, value double")
    got = {r["concept"]: r["invalid"] for r in q.concept_rule_counts(df, "concept", "value", contract_for("sec_edgar").concept_rules).collect()}
    assert got == {"Assets": 1, "Revenues": 1}


@pytest.mark.parametrize("width", [1, 2, 3, 100])
def test_unordered_series_across_stretches(spark, width):
    rows = [("a", i, t) for i, t in enumerate([1, 2, 2, 5, 9])] + [("b", i, t) for i, t in enumerate([1, 3, 2, 4, 5])]
    df = spark.createDataFrame(rows, "e string, seq long, t long")
    assert {r["entity"]: r["unordered"] for r in q.unordered_series(df, "e", "t", "seq", width).collect()} == {"a": False, "b": True}


def test_gaps_need_three_points_and_positive_median(spark):
    rows = [("a", t) for t in (1, 2, 3, 4, 20)] + [("b", 1), ("b", 9)] + [("c", t) for t in (1, 2, 3)]
    got = {r["entity"]: r["n_gaps"] for r in q.series_gaps(spark.createDataFrame(rows, "e string, t long"), "e", "t").collect()}
    assert got == {"a": 1, "c": 0}


def test_quality_score_defaults_and_grades(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.2)], "schema double, validity double, mean_iqr_pct double")
    row = one(q.quality_score(df))
    assert math.isclose(row["score"], 100 * (0.2 + 0.25 + 0.15 + 0.25 * 0.4 + 0.15)) and row["grade"] == "B"


def test_modelling_gate_levels(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("y"), F.lit(1.0).alias("const"), F.when(F.col("id") > 10, F.lit(None)).otherwise(F.lit(float("inf"))).alias("x"))
    got = {(r["level"], r["code"], r["column"]) for r in q.modelling_gate(df, "y").collect()}
    assert {("error", "sparse_column", "x"), ("error", "infinite_values", "x"), ("warn", "constant_column", "const"), ("warn", "duplicate_rows", "")} <= got
    assert [r["code"] for r in q.modelling_gate(df, "absent").collect()] == ["target_missing"]


def test_payload_issues(spark):
    df = spark.createDataFrame(
        [(1, {"a": "1", "b": "NaN"}), (2, {"a": "x", "c": "3"}), (3, {}), (4, {"a": "1.5", "b": "2"})], "id int, features map<string,string>"
    )
    got = {(r["id"], r["feature"], r["severity"]) for r in q.payload_issues(df, ["a", "b"]).collect()}
    assert got == {(1, "b", "error"), (2, "a", "error"), (2, "b", "error"), (2, "c", "warning"), (3, "", "error")}


def test_ready_to_train_names_absent_splits(spark):
    df = spark.createDataFrame([("train", 1, 1.0), ("val", 2, float("inf"))], "split string, y int, x double")
    got = {r["split"]: r["ready"] for r in q.ready_to_train(df, "y").collect()}
    assert got == {"train": True, "val": False, "test": False}


def test_scalars(spark):
    row = spark.createDataFrame([("  Big   Co ", " N/A ", "abc", 0.0)], "a string, b string, c string, z double").select(
        clean_text("a").alias("a"), clean_text("b").alias("b"), to_number("c").alias("c"), safe_ratio(F.lit(1.0), "z").alias("r"),
        risk_score(F.lit(0.32999)).alias("s"), risk_band(risk_score(F.lit(0.32999))).alias("band"), confidence(F.lit(0.9), 0.6).alias("conf"), confidence(F.lit(1.0), 1.0).alias("edge"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["r"]) == ("Big Co", None, None, None)
    assert row["s"] == 33.0 and row["band"] == "Medium" and math.isclose(row["conf"], 0.75) and row["edge"] == 1.0


def test_cross_check_names_each_violation(spark):
    folder = new_path(spark, "cross-test")
    clean = spark.createDataFrame([(i, float(i % 7)) for i in range(40)], "id long, x double")
    clean.write.parquet(f"{folder}/clean.parquet")
    write_sidecar(spark, folder, "clean", clean, 40, None, f"{folder}/clean.parquet", {})
    changed = clean.withColumn("x", F.col("x") + 1)
    changed.write.parquet(f"{folder}/changed.parquet")
    write_sidecar(spark, folder, "changed", clean, 40, None, f"{folder}/changed.parquet", {})
    spark.createDataFrame([(None, 5.0), (1, float("inf")), (1, -1.0)], "id long, x double").write.parquet(f"{folder}/bad.parquet")
    spark.createDataFrame([], "id long, x double").write.parquet(f"{folder}/empty.parquet")
    contracts = {n: Contract(n, required={"id": "integer"}, keys=("id",), ranges={"x": (0.0, 100.0)}, min_rows=3) for n in ("clean", "changed", "bad", "empty", "lost", "never")}
    out = cross_check(spark, folder, "2024-01-20", contracts, {"lost": "success"})
    rows = {tuple(r) for r in out.collect()}
    assert rows == {
        ("clean", "summary", "PASS", "", None), ("changed", "integrity", "FAIL", "", None), ("empty", "row_count", "FAIL", "", 0.0),
        ("bad", "key_nulls", "FAIL", "id", 1.0), ("bad", "key_uniqueness", "WARN", "id", 1.0), ("bad", "value_range", "FAIL", "x", 2.0), ("bad", "infinities", "FAIL", "x", 1.0),
        ("lost", "coverage", "FAIL", "", None), ("never", "coverage", "WARN", "", None),
    }
    worst = {r["source"]: r["worst"] for r in cross_summary(out).collect()}
    assert worst == {"clean": "PASS", "changed": "FAIL", "bad": "FAIL", "empty": "FAIL", "lost": "FAIL", "never": "WARN"}
