"""Encoding of columns with any number of values, hot ones included."""
import pytest
from pyspark.sql import functions as F

from insolvia.operators import prepare as pr


@pytest.fixture
def many(spark):
    """120 values of which one fills half the rows; nulls; a column whose names the encoder might use inside."""
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 19 == 0, F.lit(None)).otherwise(F.concat(F.lit("v"), F.lpad((F.col("id") % 119).cast("string"), 3, "0"))).alias("s"))
    return df.withColumn("value", F.lit(1)).withColumn("code", F.lit(2)).repartition(5)


def codes_of(df):
    values = sorted({r["s"] for r in df.collect() if r["s"] is not None})
    return {v: i for i, v in enumerate(values)}


@pytest.mark.parametrize("hot", [False, True])
def test_ordinal_codes_of_a_long_vocabulary(spark, many, hot, request):
    if hot:
        request.getfixturevalue("tiny_tasks")  # values with more than 40 rows take the broadcast route
    train = many.filter("id % 7 != 0 and id % 119 != 5")
    fitted = pr.fit_categories(train, ["s"])
    want = codes_of(train)
    assert fitted["categories"] == {} and fitted["dictionaries"]["s"]["size"] == len(want) > 50
    out = pr.apply_ordinal(many, fitted)
    assert out.columns == many.columns
    source = {r["id"]: r["s"] for r in many.collect()}
    got = {r["id"]: r["s"] for r in out.collect()}
    assert got == {i: float(want.get(s, -1)) for i, s in source.items()}


@pytest.mark.parametrize("drop_first", [False, True])
def test_onehot_vector_of_a_long_vocabulary(many, drop_first):
    train = many.filter("id % 119 != 5")
    fitted, want = pr.fit_categories(train, ["s"]), codes_of(train)
    source = {r["id"]: r["s"] for r in many.collect()}
    rows = pr.apply_onehot(many, fitted, drop_first).collect()
    assert len(rows) == 2000 and "s" not in rows[0].asDict()
    for r in rows:
        code = want.get(source[r["id"]], -1) - drop_first
        assert r["s="].size == len(want) - drop_first and r["s="].indices.tolist() == ([code] if code >= 0 else [])


def test_short_and_long_columns_together(spark, many):
    df = many.withColumn("t", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    fitted = pr.fit_categories(df, ["s", "t"])
    assert list(fitted["categories"]) == ["t"] and list(fitted["dictionaries"]) == ["s"]
    assert set(pr.apply_onehot(df, fitted).columns) == {"id", "value", "code", "t=a", "t=b", "s="}
    assert pr.fit_categories(df.filter("false"), ["s"])["categories"] == {"s": []}
