"""Pivot search: bounds never lose a neighbour, clustered data visits few blocks, gaps are filled in one pass."""
import math

import numpy as np
import pytest

from insolvia.operators import neighbors as nb


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(nb, "CELL_ROWS", 12)
    monkeypatch.setattr(nb, "REFERENCE_BLOCK", 40)
    monkeypatch.setattr(nb, "QUERY_BLOCK", 16)


def frame(spark, x, payload=False):
    rows = [(i, [float(v) for v in row], *([float(i % 2)] if payload else [])) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>" + (", payload double" if payload else "")).repartition(3)


def clusters(seed, n, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-10, 10, (8, 3))
    return np.round(centres[rng.integers(0, 8, n)] + rng.normal(0, spread, (n, 3)), 2)


def check_nearest(got, ref, qry, k):
    assert len(got) == len(qry) * min(k, len(ref))
    for q, g in got.sort_values(["q_id", "rank"]).groupby("q_id"):
        d = np.sqrt(((ref - qry[q]) ** 2).sum(axis=1))
        assert g["r_id"].tolist() == sorted(range(len(ref)), key=lambda i: (d[i], i))[:k]


@pytest.mark.parametrize("kind", ["clusters", "noise", "one point", "few"])
def test_neighbours_are_exact(spark, small_cells, kind):
    rng = np.random.default_rng(1)
    ref = {"clusters": clusters(1, 300), "noise": np.round(rng.normal(size=(250, 3)), 1), "one point": np.ones((150, 3)), "few": rng.normal(size=(3, 3))}[kind]
    qry = np.vstack([ref[:20] + 0.01, rng.uniform(-12, 12, (20, 3))])
    check_nearest(nb.nearest(frame(spark, qry), frame(spark, ref, True), 7).toPandas(), ref, qry, 7)


def test_clustered_queries_visit_few_blocks(spark, small_cells):
    ref, qry = clusters(3, 800), clusters(3, 60)
    _, pairs = nb._met(frame(spark, qry), frame(spark, ref, True), 3, False)
    _, cells = nb._celled(frame(spark, ref, True), 3, 3)
    visits, home = cells.visits(qry, 3)
    every = int(cells.blocks()[cells.size > 0].sum()) * len(np.unique(home))
    assert pairs.count() < 0.25 * every
    assert visits.sum() < 0.25 * visits.size


def test_bounds_hold_for_every_cell():
    rng = np.random.default_rng(5)
    ref, qry = rng.normal(size=(400, 4)), rng.normal(size=(30, 4)) * 2
    cells = nb.Cells(ref[:25].copy(), np.ones((25, 4), bool), np.zeros(25, bool))
    cell, radius = cells.assign(ref)
    for j in range(25):
        at = cell == j
        cells.size[j], cells.low[j], cells.high[j], cells.largest[j], cells.radii[j] = at.sum(), ref[at].min(axis=0), ref[at].max(axis=0), radius[at].max(), np.sort(radius[at])[:5]
    visits, _ = cells.visits(qry, 5)
    for i, q in enumerate(qry):
        near = np.argsort(((ref - q) ** 2).sum(axis=1))[:5]
        assert visits[i][cell[near]].all()
    assert visits.mean() < 0.9


def brute_impute(x, k):
    out = x.copy()
    for i, j in zip(*np.where(np.isnan(x))):
        ds = []
        for r in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[r])
            if not np.isnan(x[r, j]) and both.any():
                ds.append((math.sqrt(((x[i, both] - x[r, both]) ** 2).sum() * x.shape[1] / both.sum()), r))
        out[i, j] = np.mean([x[r, j] for _, r in sorted(ds)[:k]]) if ds else np.nanmean(x[:, j])
    return out


@pytest.mark.parametrize("patterns", [64, 2])
def test_gaps_are_filled_exactly(spark, small_cells, monkeypatch, patterns):
    monkeypatch.setattr(nb, "MAX_PATTERNS", patterns)  # two common patterns, all others share one cell
    rng = np.random.default_rng(7)
    x = np.hstack([clusters(9, 150), np.round(rng.normal(size=(150, 1)), 2)])
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5] = np.nan  # a row that holds nothing
    rows = [(i, *[None if np.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]  # null and NaN alike
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = nb.knn_impute(df, df, "id", ["a", "b", "c", "d"], 4).toPandas().sort_values("id")[["a", "b", "c", "d"]].to_numpy(float)
    assert np.allclose(got, brute_impute(x, 4), atol=1e-9)


def test_gaps_without_donors_take_the_mean(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 4.0), (3, 5.0, None)], "id long, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in nb.knn_impute(df, df, "id", ["a", "b"], 2).collect()}
    assert got == {1: (5.0, 2.0), 2: (5.0, 4.0), 3: (5.0, 3.0)}


def test_wide_vectors_are_exact(spark, small_cells):
    rng = np.random.default_rng(11)
    ref = np.round(rng.normal(size=(220, 24)), 1) + 1_000.0  # far from the origin: products alone would lose the small differences
    ref[100:130] = ref[5]  # ties beyond k
    qry = np.vstack([ref[:12], ref[20:30] + 0.01])
    check_nearest(nb.nearest(frame(spark, qry), frame(spark, ref, True), 7).toPandas(), ref, qry, 7)


def test_a_query_meets_few_references(monkeypatch):
    """The own cell tells how near the k-th neighbour is; few other cells are looked into."""
    rng = np.random.default_rng(12)
    ref, qry = rng.normal(size=(20_000, 3)), rng.normal(size=(300, 3))
    cells = nb.Cells(ref[:100].copy(), np.ones((100, 3), bool), np.zeros(100, bool))
    cell, radius = cells.assign(ref)
    for j in range(100):
        at = cell == j
        cells.size[j], cells.low[j], cells.high[j], cells.largest[j], cells.radii[j] = at.sum(), ref[at].min(axis=0), ref[at].max(axis=0), radius[at].max(), np.sort(radius[at])[:5]

    class Rows:
        read = 0

        def blocks(self, j):
            at = np.flatnonzero(cell == j)
            for part in np.array_split(at, 2):
                yield ref[part], part.astype(np.int64), np.zeros(len(part))

    met, meet = [0], nb._meet
    monkeypatch.setattr(nb, "_meet", lambda best, x, rows, block, *more: met.__setitem__(0, met[0] + len(rows) * len(block[0])) or meet(best, x, rows, block, *more))
    best, _ = nb._found(qry, cells.home(qry, False), cells, Rows(), 5, False)
    for i, q in enumerate(qry):
        assert best.id[i, 0].tolist() == np.argsort(((ref - q) ** 2).sum(axis=1), kind="stable")[:5].tolist()
    assert met[0] < 0.08 * len(ref) * len(qry)
    assert met[0] < cells.size[np.newaxis].repeat(len(qry), 0)[cells.visits(qry, 5)[0]].sum()  # fewer than the cells' numbers alone allow


def test_repeated_and_null_query_ids_and_a_cell_of_many_blocks(spark, small_cells):
    ref = np.zeros((130, 2))
    ref[::13] = 1.0
    refs = frame(spark, ref, True)
    queries = spark.createDataFrame([(1, [0.9, 1.0]), (1, [0.9, 1.0]), (None, [0.1, 0.0])], "id long, vec array<double>")
    got = nb.nearest(queries, refs, 4).toPandas()
    assert sorted(got[got["q_id"] == 1]["r_id"]) == [0, 0, 13, 13] and sorted(got[got["q_id"].isna()]["r_id"]) == [1, 2, 3, 4]


def test_candidates_share_each_folds_search(spark, monkeypatch):
    from insolvia.operators import models as md

    rng = np.random.default_rng(13)
    y = (rng.random(240) < 0.4).astype(int)
    rows = [(i, int(t), float(rng.normal() + t), float(rng.normal()), i % 3) for i, t in enumerate(y)]
    df = spark.createDataFrame(rows, "entity_id long, target int, a double, b double, fold int")
    space = [{"k": k, "weights": w} for k in (3, 9) for w in ("uniform", "distance")]
    alone = {str(c): md.cross_validate("knn", df, ["a", "b"], "target", "fold", [c])[0]["scores"] for c in space}
    calls, search = [], md.nearest
    monkeypatch.setattr(md, "nearest", lambda *a: calls.append(a[2]) or search(*a))
    together = md.cross_validate("knn", df, ["a", "b"], "target", "fold", space)
    assert calls == [9, 9, 9]
    assert all(np.allclose(r["scores"], alone[str(r["params"])]) for r in together)
