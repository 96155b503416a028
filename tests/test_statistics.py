"""Association, metrics and profile tables against brute force in NumPy and pandas."""
import itertools
import math

import numpy as np
import pandas as pd
import pytest

from insolvia.operators import metrics as m
from insolvia.operators import profile as p
from insolvia.operators import quality as qu
from insolvia.operators import relations as rel


def frame(n=150, seed=0):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    a = np.where(rng.random(n) < 0.34, 1.0, np.round(rng.normal(size=n) + 2 * y, 1))
    return pd.DataFrame({"id": np.arange(n), "y": y, "a": a, "b": np.round(a + rng.normal(size=n), 1), "c": np.round(rng.exponential(size=n), 2), "k": 4.0})


def tau_b(x, y):
    s = t = u = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        dx, dy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, t, u = s + dx * dy, t + abs(dx), u + abs(dy)
    return s / math.sqrt(t * u)


def test_kendall_counts_every_pair(tiny_tasks):
    pdf = frame()
    got = {(r["feature_a"], r["feature_b"]): r["tau"] for r in rel.kendall(tiny_tasks.createDataFrame(pdf), ["a", "b", "c"]).collect()}
    assert len(got) == 3
    for (x, y), tau in got.items():
        assert math.isclose(tau, tau_b(pdf[x].to_numpy(), pdf[y].to_numpy()), abs_tol=1e-12)


def test_correlations_ignore_constants_and_match_pandas(tiny_tasks):
    pdf = frame(150, 1)
    df = tiny_tasks.createDataFrame(pdf)
    want = pdf[["a", "b", "c"]].corr()
    for r in rel.pearson(df, ["a", "b", "c", "k"]).collect():
        if "k" in (r["feature_a"], r["feature_b"]):
            assert r["r"] is None
        else:
            assert math.isclose(r["r"], want.loc[r["feature_a"], r["feature_b"]], abs_tol=1e-9)
    rank = pdf[["a", "b", "c"]].corr("spearman")
    for r in rel.spearman(df, "id", ["a", "b", "c"]).collect():
        assert math.isclose(r["r"], rank.loc[r["feature_a"], r["feature_b"]], abs_tol=1e-9)


def test_variance_inflation_of_a_near_copy(spark):
    pdf = frame(300, 2)
    pdf["d"] = pdf["a"] + 0.01 * np.random.default_rng(9).normal(size=300)
    got = {r["feature"]: r["vif"] for r in rel.variance_inflation(spark.createDataFrame(pdf), ["a", "c", "d"]).collect()}
    assert got["a"] > 100 and got["d"] > 100 and got["c"] < 100


def test_univariate_auc_is_not_flipped(tiny_tasks):
    pdf = frame(200, 3)
    pdf["neg"] = -pdf["a"]
    got = {r["feature"]: r["auc"] for r in rel.univariate_auc(tiny_tasks.createDataFrame(pdf), "y", ["a", "neg"]).collect()}
    assert got["a"] > 0.8 and math.isclose(got["a"] + got["neg"], 1.0)


def test_target_association_shapes(spark):
    pdf = frame(300, 4)
    df = spark.createDataFrame(pdf)
    d = {r["feature"]: r["cohens_d"] for r in rel.cohens_d(df, "y", ["a", "c", "k"]).collect()}
    assert d["a"] > 1 and d["k"] == 0.0
    mi = {r["feature"]: r["mutual_info"] for r in rel.mutual_information(df, "y", ["a", "c", "k"]).collect()}
    assert mi["a"] > mi["c"] >= 0 and abs(mi["k"]) < 1e-12
    f = {r["feature"]: r["f_score"] for r in rel.anova_f(df, "y", ["a", "c"]).collect()}
    assert f["a"] > f["c"]


def test_descriptive_table_matches_pandas(spark):
    pdf = frame(200, 5)
    got = {r["feature"]: r for r in p.descriptive_statistics(spark.createDataFrame(pdf), ["a", "c", "k"]).collect()}
    for c in ("a", "c", "k"):
        s, r = pdf[c], got[c]
        assert math.isclose(r["mean"], s.mean()) and math.isclose(r["median"], s.median()) and r["mode"] == s.mode().iloc[0]
        assert math.isclose(r["p95"], s.quantile(0.95)) and math.isclose(r["std"], s.std(), abs_tol=1e-12)
    assert got["k"]["skewness"] == 0.0 and got["k"]["kurtosis"] == 0.0
    z = (pdf.c - pdf.c.mean()) / pdf.c.std(ddof=0)
    assert math.isclose(got["c"]["skewness"], (z**3).mean(), rel_tol=1e-9)


def test_histogram_matches_numpy(spark):
    pdf = frame(200, 6)
    got = p.histograms(spark.createDataFrame(pdf), ["c"], 10).toPandas().sort_values("bin")
    assert got["n"].tolist() == np.histogram(pdf["c"], bins=10)[0].tolist()
    assert p.histograms(spark.createDataFrame(pdf), ["k"], 3).toPandas().sort_values("bin")["n"].tolist() == np.histogram(pdf["k"], bins=3)[0].tolist()


def scores(n=220, seed=7):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    return pd.DataFrame({"id": np.arange(n), "y": y, "p": np.round(0.6 * y + 0.4 * rng.random(n), 2)})


def brute_ap(y, p):
    out, seen_recall = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / y.sum()
        out += (recall - seen_recall) * y[hit].mean()
        seen_recall = recall
    return out


def test_metric_suite_against_brute_force(tiny_tasks):
    pdf = scores()
    y, prob = pdf.y.to_numpy(), pdf.p.to_numpy()
    r = m.evaluate(tiny_tasks.createDataFrame(pdf), 0.5).first()
    wins = [(a > b) + 0.5 * (a == b) for a in prob[y == 1] for b in prob[y == 0]]
    assert math.isclose(r["roc_auc"], np.mean(wins)) and math.isclose(r["pr_auc"], brute_ap(y, prob))
    hit = prob >= 0.5
    assert (r["tp"], r["fp"]) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum())
    assert math.isclose(r["mcc"], np.corrcoef(hit, y)[0, 1]) and math.isclose(r["brier_score"], ((prob - y) ** 2).mean())


def test_thresholds(tiny_tasks):
    pdf = scores(seed=8)
    counts = m.score_counts(tiny_tasks.createDataFrame(pdf))
    y, prob = pdf.y.to_numpy(), pdf.p.to_numpy()
    gaps = {t: (prob[y == 1] >= t).mean() - (prob[y == 0] >= t).mean() for t in set(prob)}
    best = max(gaps.values())
    assert m.choose_threshold(counts, "youden")[0] == max(t for t, g in gaps.items() if math.isclose(g, best))
    f1 = {t: 2 * ((prob >= t) & (y == 1)).sum() / ((prob >= t).sum() + y.sum()) for t in set(prob)}
    assert m.choose_threshold(counts, "max_f1")[0] == min(t for t, v in f1.items() if math.isclose(v, max(f1.values())))
    assert m.choose_threshold(counts, "custom", 0.3) == (0.3, "custom")


def test_single_class_and_useless_scores(spark):
    flat = spark.createDataFrame([(0, 0.2), (0, 0.8)], "y int, p double")
    assert m.choose_threshold(m.score_counts(flat), "youden") == (0.5, "default")
    reversed_ = spark.createDataFrame([(1, 0.1), (0, 0.9)], "y int, p double")
    assert m.choose_threshold(m.score_counts(reversed_), "youden")[0] == 1.0
    zero = m.threshold_metrics(m.confusion(flat, 0.9)).first()
    assert (zero["precision"], zero["recall"], zero["f1"], zero["mcc"]) == (0.0, 0.0, 0.0, 0.0)


def test_f1_looks_at_every_score(spark):
    pdf = scores(400, 9)
    pdf["p"] = np.random.default_rng(1).random(400)
    t = m.max_f1_threshold(m.score_counts(spark.createDataFrame(pdf)))
    every = np.sort(pdf.p.unique())
    f1 = [2 * ((pdf.p >= g) & (pdf.y == 1)).sum() / ((pdf.p >= g).sum() + pdf.y.sum()) for g in every]
    assert math.isclose(t, every[int(np.argmax(f1))], abs_tol=1e-12)


def test_kendall_keeps_every_column(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.integers(0, 5, (12, 45)), columns=[f"x{i}" for i in range(45)])
    found = rel.kendall(spark.createDataFrame(pdf), list(pdf.columns)).select("feature_a", "feature_b").collect()
    assert {f"x{i}" for i in range(45)} <= {c for r in found for c in r}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (None, 5.0), (4.0, 8.0)], "a double, b double")
    counts = {r["column"]: r["missing"] for r in qu.missing_counts(df).collect()}
    assert counts == {"a": 2, "b": 0}
    assert abs(rel.correlation_matrix(df, ["a", "b"])[0, 1] - 1.0) < 1e-12


def test_lift_and_gain(tiny_tasks):
    pdf = scores(seed=10)
    got = m.cumulative_lift(tiny_tasks.createDataFrame(pdf)).toPandas()
    ranked = pdf.sort_values(["p", "id"], ascending=[False, True])
    for _, r in got.iterrows():
        assert math.isclose(r["lift"], ranked.y.head(int(r["n"])).mean() / pdf.y.mean())
    assert math.isclose(got["lift"].iloc[-1], 1.0)


@pytest.mark.parametrize("missing", [None, 0.9])
def test_leaderboard_puts_missing_last(spark, missing):
    df = spark.createDataFrame([("a", missing, 0.1, 0.1, 0.1), ("b", 0.8, 0.1, 0.1, 0.1)], "model string, roc_auc double, f1 double, recall double, pr_auc double")
    first = m.leaderboard(df).filter("rank = 1").first()["model"]
    assert first == ("a" if missing else "b")
