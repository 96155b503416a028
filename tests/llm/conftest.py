"""Small frames of documents that hold the awkward cases."""
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(texts) with ids 0.., or documents([(id, text), …])."""

    def make(rows, lang="en"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t in rows], SCHEMA)

    return make


@pytest.fixture
def awkward(documents):
    """Nulls, empty and blank texts, ties, repeated rows and a long text, with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 97} and{i % 13}" for i in range(40_000))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "short text"), (3, "short text"), (4, "short text"), (5, long), (6, long), (None, "short text"), (None, None), (7, "ÄÖ — naïve 日本 😀")]
    df = documents(rows)
    for name in ("id", "key", "n", "digest", "norm", "part", "node", "low", "_id", "window", "c0", "n_words", "score"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture
def nothing(documents):
    return documents([(0, "x")]).where("false")
