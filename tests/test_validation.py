"""A folder's validation run: reports, absent and broken datasets, duplicates from one shuffle."""
import pytest
from pyspark.sql import functions as F

from insolvia.functions.contracts import Contract
from insolvia.operators import quality as q
from insolvia.plans import crosscheck, validation
from insolvia.session import new_path
from insolvia.store import files

PRICES = Contract("prices", required={"id": "integer", "day": "datetime", "v": "numeric"}, entity="id", dates=("day",), nonneg=("v",))


@pytest.fixture
def prices(spark):
    rows = [(i, i % 3, f"2024-01-{1 + i // 3:02d}", float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "seq long, id long, day string, v double").withColumn("day", F.to_timestamp("day"))


def test_clean_table_has_only_good_news(prices):
    found, summary = validation.validate_source(prices, "prices", PRICES, "2024-02-01", 2024, "seq")
    assert {(f[0], f[1]) for f in found} == {(c, "ok") for c in ("schema", "missing", "duplicates", "financial", "outliers", "timeseries")}
    assert summary["is_valid"] and summary["n_errors"] == 0 and summary["quality_score"] == 100.0


def test_each_fault_is_a_finding(spark, prices):
    bad = prices.withColumn("v", F.when(F.col("seq") == 5, -1.0).when(F.col("seq") == 7, float("nan")).otherwise(F.col("v")))
    bad = bad.withColumn("day", F.when(F.col("seq") == 9, F.lit("2031-01-01").cast("timestamp")).otherwise(F.col("day")))
    bad = bad.unionByName(bad.filter("seq = 4").withColumn("seq", F.lit(1000).cast("long"))).withColumn("extra", F.lit(1))
    found, summary = validation.validate_source(bad, "prices", PRICES.with_changes(required={**PRICES.required, "w": "numeric"}), "2024-02-01", 2024, "seq")
    got = {(f[1], f[3]): f[4] for f in found}
    assert got[("missing_required_columns", "w")] is None and ("unexpected_columns", "extra") in got
    assert got[("negative_value", "v")] == 1 and got[("some_missing", "v")] == 1 and got[("future_date", "day")] == 1
    assert got[("duplicate_rows", "")] == 1 and got[("duplicate_entity_timestamps", "id,day")] == 1
    assert got[("not_chronological", "day")] == 2 and got[("duplicate_timestamps", "day")] == 1
    assert not summary["is_valid"] and summary["n_errors"] == 3


@pytest.mark.parametrize("contract", [PRICES, Contract("x", dates=("day",)), Contract("y", entity="id"), Contract("z")])
def test_both_duplicate_counts_equal_separate_ones(prices, contract):
    df = prices.unionByName(prices.filter("seq < 10")).unionByName(prices.filter("seq = 3")).drop("seq")
    rows, keyed = validation.duplicate_totals(df, contract)
    assert rows == q.duplicate_rows(df).first()["duplicate_rows"] == 11
    assert keyed == [tuple(r) for r in q.natural_key_duplicates(df, contract).collect()]


def test_folder_run_writes_reports_and_goes_on(spark, prices):
    folder = new_path(spark, "folder")
    prices.write.parquet(f"{folder}/prices.parquet")
    prices.limit(0).write.parquet(f"{folder}/empty.parquet")
    spark.createDataFrame([("no",)], "value string").write.text(f"{folder}/broken.parquet")
    findings, summary = validation.validate_folder(spark, folder, "2024-02-01", 2024, {"prices": PRICES, "absent": Contract("absent")}, order={"prices": "seq"}, reports=f"{folder}/reports")
    rows = {r["source"]: r for r in summary.collect()}
    assert set(rows) == {"prices", "absent", "broken", "empty"}
    assert not rows["absent"]["present"] and rows["broken"]["load_error"] and rows["empty"]["n_rows"] == 0 and rows["prices"]["is_valid"]
    assert {r["source"] for r in findings.collect()} == {"prices", "empty"}
    report = files.read_json(spark, f"{folder}/reports/prices.json")
    assert len(report["findings"]) == 6 and report["quality_grade"] == rows["prices"]["quality_grade"]
    totals = files.read_json(spark, f"{folder}/reports/_summary.json")
    assert (totals["n_datasets"], totals["n_present"], totals["n_valid"]) == (4, 3, 2)


def test_corpus_checks_need_two_sources(spark, prices):
    folder = new_path(spark, "corpus")
    prices.write.parquet(f"{folder}/prices.parquet")
    assert [tuple(r) for r in crosscheck.corpus_checks(spark, folder, {"prices": PRICES}).collect()] == [("corpus", "WARN", "", 1)]
    prices.withColumn("id", F.col("id") + 100).write.parquet(f"{folder}/other.parquet")
    prices.withColumn("id", F.lit(None).cast("long")).write.parquet(f"{folder}/void.parquet")
    got = {tuple(r) for r in crosscheck.corpus_checks(spark, folder, {s: Contract(s, entity="id") for s in ("prices", "other", "void")}).collect()}
    assert got == {("entity_size", "PASS", "prices", 3), ("entity_size", "PASS", "other", 3), ("entity_overlap", "WARN", "other,prices", 0), ("corpus", "PASS", "", 3)}
