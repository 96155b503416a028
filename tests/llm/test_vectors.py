"""Whitening and hard negatives against brute force in plain numpy and Python integers."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from insolvia.llm import hardneg, whitening

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def vectors(spark):
    """vectors(rows) of (vec_id, embedding, label), with columns whose names the operators use inside."""

    def make(rows):
        df = spark.createDataFrame([(i, v, k) for i, v, k in rows], "vec_id long, embedding array<float>, label int")
        for name in ("id", "x", "key", "part", "index", "row", "best", "bound", "score", "_part", "n"):
            df = df.withColumn(name, F.lit(name))
        return df.repartition(3)

    return make


def random_rows(n, dims, seed, labels=3, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.3, dims).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]
    return rows + [(n + i, rows[i % 7][1], rows[i % 7][2]) for i in range(copies)]


AWKWARD = [(900, None, 1), (901, [NAN, 0.1, 0.1], 1), (902, [INF, 0.1, 0.1], 1), (903, [None, 0.1, 0.1], 1)]


# ---------------------------------------------------------------- hard negatives
def brute_negatives(rows, every, scale=256, k=5, percent=80):
    """The definition, over Python integers."""
    usable = set()
    for ident, vector, label in rows:
        if ident is None or vector is None or label is None or any(c is None or not math.isfinite(c) for c in vector):
            continue
        usable.add((ident, label, tuple(math.floor(scale * float(np.float32(c))) for c in vector)))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in usable:
        if a[0] % every:
            continue
        others = [(-dot(a[2], b[2]), b[0], b[1]) for b in usable if b != a]
        for score, ident, label in sorted(o for o in others if o[2] == a[1])[:k]:
            p = -score
            near = sorted(o for o in others if o[2] != a[1] and percent * p <= -100 * o[0] <= 100 * p)[:k]
            out += [(a[0], ident, rank, o[1], p, -o[0]) for rank, o in enumerate(near, 1)]
    return sorted(out)


def mined(df, every, **options):
    return sorted(map(tuple, hardneg.mine_hard_negatives(df, F.col("id") % every == 0, **options).collect()))


@pytest.mark.parametrize("block_rows", [None, 20])
def test_hard_negatives_equal_brute_force(vectors, block_rows):
    rows = random_rows(260, 8, 1, copies=90) + AWKWARD + [(None, [0.1] * 8, 1), (5, [0.2] * 8, None)]
    expected = brute_negatives(rows, 10)
    assert len(expected) > 100
    assert mined(vectors(rows), 10, block_rows=block_rows) == expected


def test_hard_negatives_with_ties_and_one_hot_label(vectors):
    rows = [(i, [0.5, 0.25], 1 if i % 3 else 2) for i in range(120)]  # all scores equal: ids decide
    assert mined(vectors(rows), 20, block_rows=16) == brute_negatives(rows, 20)


def test_hard_negatives_repeated_rows_and_shared_ids(vectors):
    rows = random_rows(60, 4, 3) * 4 + [(10, [0.9] * 4, 1), (10, [0.8] * 4, 1), (10, [0.8] * 4, 2)]
    assert mined(vectors(rows), 10, block_rows=8) == brute_negatives(rows, 10)


def test_hard_negatives_of_negative_and_zero_scores(vectors):
    rows = [(0, [-1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, -1.0], 1), (4, [2.0, 0.0], 1), (5, [-0.9, 0.0], 1)]
    assert mined(vectors(rows), 10) == brute_negatives(rows, 10)


def test_hard_negatives_of_nothing(vectors, spark):
    empty = vectors([(1, [0.1], 1)]).where("false")
    assert mined(empty, 1) == []
    assert mined(vectors([(0, [], 1), (1, [], 1), (2, [], 2)]), 1) == brute_negatives([(0, [], 1), (1, [], 1), (2, [], 2)], 1)
    assert mined(vectors(AWKWARD), 1) == []


def test_shorter_vectors_are_filled_up(vectors):
    rows = random_rows(30, 4, 5) + [(100 + i, [0.4 + i / 50, 0.3], i % 3) for i in range(10)]
    filled = [(i, v + [0.0] * (4 - len(v)), k) for i, v, k in rows]
    assert mined(vectors(rows), 10, block_rows=8) == brute_negatives(filled, 10)


@pytest.mark.parametrize("size", [1, 5, 200, 2**15, 2**24, 2**31, 2**50])
def test_packed_products_are_exact(size):
    rng = random.Random(size)
    rows = np.array([[rng.randint(-size, size) for _ in range(9)] for _ in range(37)], np.int64)
    anchors = np.array([[rng.randint(-size // 3 - 1, size) for _ in range(9)] for _ in range(11)], np.int64)
    exact = rows.astype(object) @ anchors.T.astype(object)
    assert (hardneg.inner_products(rows, anchors).astype(object) == np.clip(exact, -hardneg.TOP, hardneg.TOP).T).all()


def test_fields_of_a_word_do_not_touch():
    values = np.array([[3, 7], [1, 0], [2, 5]], np.uint64)
    words = hardneg.pack(values, 8, 2)
    assert words.tolist() == [[3 + (1 << 8), 7], [2, 5]]


def test_best_keeps_the_order_of_equal_scores():
    scores = np.array([5, 9, 5, 9, 1, 5], np.int64)
    assert hardneg.best(scores, 4).tolist() == [1, 3, 0, 2]
    assert hardneg.best(scores, 10).tolist() == [1, 3, 0, 2, 5, 4]


# ---------------------------------------------------------------- whitening
def brute_whitening(rows, dims):
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (dims - len(v))) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in usable}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    white = vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-30))
    out = {}
    for ident, x in usable:
        gap = [n * a - s for a, s in zip(x, sums)]
        out.setdefault(ident, []).append((sum(g * g for g in gap), (np.array(gap, float) / n) @ white))
    return n, values[::-1] / covariance.trace(), out


def test_whitening_equals_brute_force(vectors):
    rows = random_rows(150, 20, 7, copies=60) + AWKWARD
    n, explained, expected = brute_whitening(rows, 20)
    got = whitening.whiten(vectors(rows)).collect()
    assert len(got) == 210 * 16 and {r["n"] for r in got} == {n} == {150}
    sign = {}
    for r in got:
        [(deviation, scores)] = expected[r["vec_id"]]
        k = r["component"]
        assert r["deviation"] == deviation and abs(r["explained"] / explained[k - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
        sign.setdefault(k, np.sign(scores[k - 1]) * np.sign(r["whitened"]))
        assert abs(r["whitened"] - sign[k] * scores[k - 1]) < 1e-7


def test_whitening_in_many_blocks(vectors, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 2)
    rows = random_rows(200, 6, 9, copies=300)  # one vector stands many times
    _, _, expected = brute_whitening(rows, 6)
    got = whitening.whiten(vectors(rows), components=6).collect()
    assert len(got) == 500 * 6
    for r in got:
        assert abs(abs(r["whitened"]) - abs(expected[r["vec_id"]][0][1][r["component"] - 1])) < 1e-7


def test_whitening_of_repeated_rows_null_ids_and_short_vectors(vectors):
    rows = random_rows(40, 3, 11) * 2 + [(None, [0.5, 0.1, -0.2], 1), (77, [0.3], 1), (78, [], 1)]
    n, _, expected = brute_whitening(rows, 3)
    got = whitening.whiten(vectors(rows)).collect()
    assert len(got) == 83 * 3 and {r["n"] for r in got} == {n}
    for r in got:
        assert r["deviation"] in {d for d, _ in expected[r["vec_id"]]}


def test_components_without_variance(vectors):
    rows = [(i, [i / 10, 0.5, i / 5], 0) for i in range(30)]  # floor() leaves the third nearly twice the first; the second is constant
    got = whitening.whiten(vectors(rows)).collect()
    assert {r["component"] for r in got} == {1, 2, 3} and all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    assert max(r["identity_error"] for r in got) < 1e-6
    one = whitening.whiten(vectors([(1, [0.1, 0.2], 0), (1, [0.1, 0.2], 0)])).collect()
    assert [(r["whitened"], r["explained"], r["deviation"], r["n"]) for r in one] == [(None, 0.0, 0, 1)] * 4


def test_whitening_of_nothing(vectors):
    assert whitening.whiten(vectors(AWKWARD)).count() == 0
    assert whitening.whiten(vectors([(1, [0.1], 1)]).where("false")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
