"""The quality classifier: statistics against plain counting, densities against their definition, held-out accuracy."""
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from insolvia.llm import quality, queries

SMALL = "/root/testdata/sf0.01"


def logit(part, whole):
    share = part / whole if whole else 0.0
    return np.log((share + 0.002) / (1.002 - share))


def plain_statistics(text: str) -> list[float]:
    words = [w for w in text.replace("\v", " ").replace("\f", " ").split() if w]
    raw = [w.encode() for w in words]
    data = text.encode()
    count = lambda test: sum(map(test, data))
    marks = set(b".,;:?!'\"()-")
    small, capital, digit = count(lambda b: 97 <= b <= 122), count(lambda b: 65 <= b <= 90), count(lambda b: 48 <= b <= 57)
    mark, other = count(lambda b: b in marks), count(lambda b: b >= 128)
    graph = count(lambda b: 33 <= b < 127)
    symbol = graph - small - capital - digit - mark
    seen = graph + other
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = len(words)
    pairs, threes = list(zip(words, words[1:])), list(zip(words, words[1:], words[2:]))
    is_symbol = lambda b: 33 <= b < 127 and not (97 <= b <= 122 or 65 <= b <= 90 or 48 <= b <= 57 or b in marks)
    return [
        np.log1p(n), np.log1p(seen / max(n, 1)), np.log1p(n / max(len(lines), 1)), logit(capital, small + capital), logit(digit, seen), logit(symbol, seen), logit(mark, seen),
        logit(other, seen), logit(len(set(words)), n), logit(max(Counter(words).values(), default=0), n), logit(sum(a == b for a, b in pairs), n), logit(len(set(pairs)), max(n - 1, 0)),
        logit(len(threes) - len(set(threes)), max(n - 2, 0)), logit(len(lines) - len(set(lines)), len(lines)),
        logit(sum(len(w) == 1 and (w[0] in marks or is_symbol(w[0])) for w in raw), n), logit(sum(is_symbol(w[-1]) for w in raw), n),
    ]


TEXTS = ["", " \n\t", "one", "a a a a", "Hello, World! 3 | 4 *** no%%% no%%%\nline two\nline two\n\nÄÖ é 日本", "x y z x y z x y z\n" * 40, "THE END!! OF!! IT!!"]


def test_statistics_equal_plain_counting():
    together = quality.statistics([t.encode() for t in TEXTS])
    assert together.shape == (len(TEXTS), len(quality.NAMES))
    for text, row in zip(TEXTS, together):
        assert np.allclose(row, plain_statistics(text)), text
        assert np.allclose(row, quality.statistics([text.encode()])[0]), "neighbours in a chunk must not matter"
    assert quality.statistics([]).shape == (0, len(quality.NAMES))


def test_log_ratio_is_that_of_the_normal_densities():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 4)), rng.integers(0, 2, 300)
    x[y == 1] = x[y == 1] * [1, 2, 0.5, 1] + 1
    share, ridge = 0.2, 0.01
    own = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * own[k] for k in (0, 1)) / len(y)
    ratio = np.zeros(300)
    for k, sign in ((0, -1), (1, 1)):
        c = (1 - ridge) * ((1 - share) * own[k] + share * pooled) + ridge * np.eye(4)
        gap = x - x[y == k].mean(axis=0)
        ratio += sign * (-0.5 * np.einsum("ni,ij,nj->n", gap, np.linalg.inv(c), gap) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(quality.log_ratio(quality.discriminant(x, y, share, ridge), x), ratio)


def test_curve_recovers_a_logistic():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 3, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.7 * z - 0.4)))).astype(int)
    a, b = quality.fit_curve(z, y, np.ones(len(z)))
    assert abs(a - 0.7) < 0.05 and abs(b + 0.4) < 0.1


def made(documents, n=160):
    """Half prose, half noise."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 8))))
    rows = [(i, " ".join(word() + ("%%%" if i % 2 and rng.random() < 0.8 else "") for _ in range(int(rng.integers(5, 60))))) for i in range(n)]
    return documents(rows)


def test_awkward_rows(spark, documents, awkward, nothing):
    docs = made(documents)
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality")).union(spark.createDataFrame([(None, 1), (3, None), (4, 7), (9_999, 1)], "doc_id long, quality int"))
    model = quality.fit(docs, labels, F.lit(True))
    got = model.score(awkward).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(tuple(r["statistics"]), set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert sum(r["doc_id"] is None for r in got) == 2
    assert model.score(nothing).count() == 0
    right = model.score(docs).select(((F.col("score") >= 0.5).cast("int") == 1 - F.col("doc_id") % 2).alias("ok")).where("ok").count()
    assert right > 0.95 * docs.count()


def test_repeated_rows_are_learned_once(spark, documents):
    docs = made(documents, 60)
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    once = quality.fit(docs, labels, F.lit(True))
    many = quality.fit(docs.union(docs.where("doc_id = 4")).union(docs.where("doc_id = 4")), labels, F.lit(True))
    assert np.array_equal(once.classes[1].mean, many.classes[1].mean) and once.curve == many.curve


def test_without_both_labels(documents, nothing):
    docs = made(documents, 20)
    ones = docs.select("doc_id", F.lit(1).alias("quality"))
    assert {r["score"] for r in quality.fit(docs, ones, F.lit(True)).score(docs).collect()} == {1.0}
    assert {r["score"] for r in quality.fit(docs, ones.where("false"), F.lit(True)).score(docs).collect()} == {0.5}
    assert {r["score"] for r in quality.fit(nothing, ones, F.lit(True)).score(docs).collect()} == {1.0}


def test_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.op13_quality(spark, SMALL).collect()}
    known = duckdb.sql(f"select doc_id, quality from '{SMALL}/labels.parquet'").fetchall()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    held = [(got[i], q) for i, q in known if got[i]["held_out"]]
    assert sum(r["predicted"] == q for r, q in held) >= 0.97 * len(held)
    bad = [r["score"] for r, q in held if q == 0]
    good = [r["score"] for r, q in held if q == 1]
    assert np.mean([[b < g for g in good] for b in bad]) > 0.97


def test_learning_leaves_out_held_rows(spark, documents):
    docs = made(documents)
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    learn = F.crc32("id") % 4 != 2
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a, b = (quality.fit(docs, k, learn) for k in (labels, turned))
    assert a.curve == b.curve and np.array_equal(a.classes[0].inverse, b.classes[0].inverse)


@pytest.mark.parametrize("per_label", [15])
def test_sample_is_bounded(documents, per_label):
    docs = made(documents, 400)
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit(docs, labels, F.lit(True), per_label=per_label)
    right = model.score(docs).where((F.col("score") >= 0.5).cast("int") == 1 - F.col("doc_id") % 2).count()
    assert right > 0.9 * 400
