"""Random forests and boosted trees on binned columns.

Rows are written once, every feature is binned by a task of its own (cuts as Spark ML sets them, from all rows), and
tasks grow whole trees on the byte matrix, level by level, with one histogram per open node: no statistics are shuffled
and none reach the driver.  Trees of a forest are dealt over the tasks; boosting, whose rounds follow each other, is one.
Gini and variance gain, bootstrap counts, feature subsets, leaves merged when they agree, importances and
probabilities are those of Spark ML; the draws are not.  Rows are ordered by their content, so that a fit
repeats on any cluster.  Trees stay in files, which scoring tasks read one after the other.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_collect, materialize, new_path

# Fixed value of Spark ML: most bins of a column.
BINS = 32
# Bytes of rows a growing task may hold, histogram cells and rows it works on at once, rows scored in one go.
MATRIX_BYTES, CELLS, ROWS, SCORED = 500_000_000, 1 << 22, 1 << 20, 1 << 16
BYTES_PER_ROW = 40
KNOWN = {"random_forest": {"numTrees", "maxDepth", "minInstancesPerNode"}, "boosted_trees": {"maxIter", "maxDepth", "stepSize", "subsamplingRate", "minInstancesPerNode"}}
TREES = "tree int, weight double, feature binary, cut binary, child binary, value binary, gains array<double>"


def growable(name: str, classes: dict, features: Sequence[str], params: dict) -> bool:
    """Whether this module grows the model: two classes, parameters it knows, rows that fit a task."""
    rows = sum(classes.values())
    return name in KNOWN and set(params) <= KNOWN[name] and set(classes) == {0, 1} and rows * (len(features) + BYTES_PER_ROW) <= MATRIX_BYTES


# ---------------------------------------------------------------- binned columns
def _files(path: str):
    """Opened data files of a written table, by name."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    found = sorted(i.path for i in store.get_file_info(fs.FileSelector(base)) if i.path.endswith(".parquet"))
    for name in found:
        with store.open_input_file(name) as f:
            yield pq.ParquetFile(f)


def _column(path: str, name: str) -> np.ndarray:
    parts = [c for f in _files(path) for c in f.read(columns=[name]).column(name).chunks]
    if any(p.null_count for p in parts):
        raise ValueError("values to grow trees on cannot be null")
    return np.concatenate([p.to_numpy(zero_copy_only=False) for p in parts] or [np.zeros(0)])


def cuts_of(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` cuts: between all distinct values, or nearest to equal weights on both sides of each stride."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] > values[:-1]])) if len(values) else np.zeros(0, int)
    distinct = values[first]
    between = lambda i: (distinct[i] + distinct[i + 1]) / 2
    if len(distinct) - 1 <= most:
        return between(np.arange(max(0, len(distinct) - 1)))
    held = np.cumsum(np.add.reduceat(weights[order], first))
    middle, stride, at, out = (held[:-1] + held[1:]) / 2, held[-1] / (most + 1), 0, []
    target = stride
    while at < len(middle):  # once per cut
        at = max(at, int(np.searchsorted(middle, target, side="right")))
        if at < len(middle):
            out.append(at)
            target, at = target + stride, at + 1
    return between(np.array(out, int))


def _binned(train: DataFrame, features: Sequence[str], target: str, weights: tuple[float, float], rows: int) -> str:
    """Where the columns are: a row per feature with its cuts and a byte per row, and one (-1) with the labels."""
    spark = train.sparkSession
    source, path = new_path(spark, "tree-rows"), new_path(spark, "tree-columns")
    train.select(F.col(f"`{target}`").cast("byte").alias("y"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(features)]).write.parquet(source)
    most, scale = min(BINS, rows) - 1, np.array(weights)

    def bin_columns(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                y = _column(source, "y").astype(np.uint8)
                cuts, cells = np.zeros(0), y
                if i >= 0:
                    x = _column(source, f"c{i}")
                    if np.isnan(x).any():
                        raise ValueError("values to grow trees on cannot be NaN")
                    cuts = cuts_of(x, scale[y], most)
                    cells = np.searchsorted(cuts, x).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([cuts.tolist()], pa.list_(pa.float64())), pa.array([cells.tobytes()], pa.binary())], names=["column", "cuts", "cells"])

    columns = spark.range(-1, len(features), 1, min(len(features) + 1, spark.sparkContext.defaultParallelism))
    _small_groups(columns.mapInArrow(bin_columns, "column int, cuts array<double>, cells binary")).parquet(path)
    return path


def _small_groups(df: DataFrame):
    """A writer for rows of megabytes: few rows to a group."""
    return df.write.option("parquet.block.size", 16 << 20).option("parquet.block.size.row.check.min", 2).option("parquet.page.size.row.check.min", 2)


def _loaded(path: str) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Columns of bytes, labels and cuts.  Rows are ordered by label and content."""
    found = {}
    for f in _files(path):
        for batch in f.iter_batches(batch_size=1):
            found[batch.column("column")[0].as_py()] = (np.array(batch.column("cuts")[0].as_py(), float), np.frombuffer(batch.column("cells")[0].as_buffer(), np.uint8))
    label = found.pop(-1)[1]
    mark = label.astype(np.uint64) << np.uint64(63)
    mixed = np.zeros(len(label), np.uint64)
    for i in range(len(found)):
        mixed = (mixed ^ found[i][1]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mark | (mixed >> np.uint64(1)), kind="stable")
    columns, cuts = [], []
    for i in range(len(found)):  # the unordered column goes when its ordered one is there
        cut, cells = found.pop(i)
        columns.append(cells[order])
        cuts.append(cut)
    return columns, label[order], cuts


# ---------------------------------------------------------------- a tree of a forest
def _gini(one: np.ndarray, both: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        p = one / both
    return 2 * p * (1 - p)


def grow_classifier(flat: np.ndarray, width: int, label: np.ndarray, usable: np.ndarray, asked: int, scale: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> dict:
    """One tree on a bootstrap of the rows; ``flat`` is the byte matrix row by row, ``scale`` the weight of each class."""
    count = rng.poisson(1.0, len(label)).astype(np.uint8)
    rows = np.flatnonzero(count)
    slot = np.zeros(len(rows), np.int32)
    totals = np.bincount(label[rows], weights=count[rows], minlength=2).reshape(1, 2)
    nodes = {k: [v] for k, v in (("feature", np.array([-1])), ("bin", np.array([0])), ("child", np.array([-1])), ("count", totals), ("gain", np.zeros(1)))}
    open_at, made = np.zeros(1, int), 1  # the open nodes of this level, by number
    for level in range(depth):
        if not len(open_at) or not len(rows) or not len(usable):
            break
        n, m = len(open_at), min(asked, len(usable))
        subset = np.sort(usable[np.argpartition(rng.random((n, len(usable))), m - 1, axis=1)[:, :m]], axis=1) if m < len(usable) else np.tile(usable, (n, 1))
        weight = totals @ scale
        here = _gini(totals[:, 1] * scale[1], weight)
        gain, feature, cut, left = np.full(n, -np.inf), np.zeros(n, int), np.zeros(n, int), np.zeros((n, 2))
        step = max(1, CELLS // (2 * BINS))
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            some = slice(None) if step >= n else (slot >= lo) & (slot < hi)
            for j in range(m):
                hist = np.zeros((hi - lo) * BINS * 2)
                pick = subset[:, j]
                r, s = rows[some], slot[some]
                for a in range(0, len(r), ROWS):
                    at, of = r[a : a + ROWS], s[a : a + ROWS]
                    cell = flat.take(at * width + pick.take(of))
                    hist += np.bincount(((of - lo) * BINS + cell).astype(np.int64) * 2 + label.take(at), weights=count.take(at), minlength=len(hist))
                below = hist.reshape(hi - lo, BINS, 2)[:, :-1].cumsum(axis=1)
                total = totals[lo:hi, None]
                l0, l1 = below[:, :, 0], below[:, :, 1]
                r0, r1 = total[:, :, 0] - l0, total[:, :, 1] - l1
                wl, wr = l0 * scale[0] + l1 * scale[1], r0 * scale[0] + r1 * scale[1]
                w = weight[lo:hi, None]
                g = here[lo:hi, None] - wl / w * _gini(l1 * scale[1], wl) - wr / w * _gini(r1 * scale[1], wr)
                g[(l0 + l1 < max(least, 1)) | (r0 + r1 < max(least, 1))] = -np.inf
                best = g.argmax(axis=1)
                k = np.arange(hi - lo)
                better = lo + np.flatnonzero(g[k, best] > gain[lo:hi])
                gain[better], cut[better], feature[better], left[better] = g[better - lo, best[better - lo]], best[better - lo], subset[better, j], below[better - lo, best[better - lo]]
        parts = np.flatnonzero(gain > 0)
        if not len(parts):
            break
        right = totals[parts] - left[parts]
        children = np.stack([left[parts], right], axis=1).reshape(-1, 2)
        at = open_at[parts]
        for k, v in (("feature", feature), ("bin", cut), ("gain", gain)):
            nodes[k].append(v[parts])
        nodes.setdefault("at", []).append(at)
        nodes["child"].append(made + 2 * np.arange(len(parts)))
        nodes["count"].append(children)
        first, made = made, made + len(children)
        grows = (children > 0).all(axis=1) & (children.sum(axis=1) >= 2 * least)
        place = np.full(2 * n, -1, np.int32)
        keep = np.flatnonzero(grows)
        place[2 * parts[keep // 2] + keep % 2] = np.arange(len(keep))
        kept = []
        for a in range(0, len(rows), ROWS):
            r, s = rows[a : a + ROWS], slot[a : a + ROWS]
            s = place.take(2 * s + (flat.take(r * width + feature.take(s)) > cut.take(s)))
            stays = np.flatnonzero(s >= 0)
            kept.append((r[stays], s[stays]))
        rows, slot = np.concatenate([r for r, _ in kept]), np.concatenate([s for _, s in kept])
        open_at, totals = first + keep, children[keep]
    return _pruned(nodes, made, scale)


def _pruned(nodes: dict, made: int, scale: np.ndarray) -> dict:
    """Arrays of the tree after pairs of leaves that predict the same class became one leaf."""
    feature, cut, child, gain = np.full(made, -1), np.zeros(made, int), np.full(made, -1), np.zeros(made)
    count = np.concatenate(nodes["count"])
    levels = nodes.get("at", [])
    for i, at in enumerate(levels):
        feature[at], cut[at], child[at], gain[at] = nodes["feature"][i + 1], nodes["bin"][i + 1], nodes["child"][i + 1], nodes["gain"][i + 1]
    weight = count * scale
    says = weight[:, 1] > weight[:, 0]
    for at in reversed(levels):
        a = child[at]
        same = at[(feature[a] < 0) & (feature[a + 1] < 0) & (says[a] == says[a + 1])]
        feature[same], child[same] = -1, -1
    used = np.zeros(made, bool)
    used[0] = True
    for at in levels:
        live = at[used[at] & (feature[at] >= 0)]
        used[child[live]] = used[child[live] + 1] = True
    number = np.cumsum(used) - 1
    inner = feature >= 0
    child[inner] = number[child[inner]]
    both = weight.sum(axis=1)
    return {"feature": feature[used], "bin": cut[used], "child": child[used], "value": (weight[:, 1] / np.where(both > 0, both, 1.0))[used], "worth": (gain * both)[used]}


# ---------------------------------------------------------------- a round of boosting
def grow_regressor(columns: list[np.ndarray], turn: int, weighted: np.ndarray, scale: np.ndarray, rows: np.ndarray, depth: int, least: int) -> tuple[dict, np.ndarray]:
    """One tree of least squares on ``rows``, and the leaf of every row.

    Rows before ``turn`` are of class 0, the others of class 1, ``weighted`` is weight times wanted value.  A level
    counts the lesser child of each pair; its sibling is the parent less that.  Row counts are whole numbers, so the
    difference is exact where it decides whether a side is empty.
    """
    width = len(columns)

    def counted(some: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        held, sums = np.zeros((width, 2, n * BINS)), np.zeros((width, n * BINS))
        for a in range(0, len(some), ROWS):
            r, base = some[a : a + ROWS], of[a : a + ROWS].astype(np.int64) * BINS
            half, v = int(np.searchsorted(r, turn)), weighted.take(r)
            for f, column in enumerate(columns):
                cell = base + column.take(r)
                held[f, 0] += np.bincount(cell[:half], minlength=n * BINS)
                held[f, 1] += np.bincount(cell[half:], minlength=n * BINS)
                sums[f] += np.bincount(cell, weights=v, minlength=n * BINS)
        return held.reshape(width, 2, n, BINS), sums.reshape(width, n, BINS)

    made, open_at = 1, np.zeros(1, int)
    most = 2 ** (depth + 1) - 1
    feature, cut, child, value, worth = np.full(most, -1), np.zeros(most, int), np.full(most, -1), np.zeros(most), np.zeros(most)
    leaf = np.zeros(len(weighted), np.int32)  # of every row, also those that were not drawn
    held, sums = counted(rows, np.zeros(len(rows), np.int32), 1)
    for level in range(depth + 1):
        n = len(open_at)
        count = held[0].sum(axis=2)  # class x node
        weight, total = scale @ count, sums[0].sum(axis=1)
        value[open_at] = total / np.where(weight > 0, weight, 1.0)
        if level == depth:
            break
        below, sum_below = held.cumsum(axis=3)[..., :-1], sums.cumsum(axis=2)[..., :-1]
        above = count[None, :, :, None] - below
        wl, wr = (np.einsum("c,fcnb->fnb", scale, x) for x in (below, above))
        sum_above = total[None, :, None] - sum_below
        ok = (below.sum(axis=1) >= max(least, 1)) & (above.sum(axis=1) >= max(least, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, sum_below**2 / wl + sum_above**2 / wr - (total**2 / weight)[None, :, None], -np.inf) / weight[None, :, None]
        flat = gain.transpose(1, 0, 2).reshape(n, -1)
        best = flat.argmax(axis=1)
        best_gain = flat[np.arange(n), best]
        # rounding of equal sides is no gain
        parts = np.flatnonzero(best_gain > 1e-15 * (total / weight) ** 2)
        if not len(parts):
            break
        f, b = best[parts] // (BINS - 1), best[parts] % (BINS - 1)
        at = open_at[parts]
        first = made
        feature[at], cut[at], child[at], worth[at] = f, b, first + 2 * np.arange(len(parts)), best_gain[parts] * weight[parts]
        made += 2 * len(parts)
        for a in range(0, len(leaf), ROWS):  # every row of a parted node goes down
            of = leaf[a : a + ROWS]
            split = feature.take(of)
            on = np.flatnonzero((child.take(of) >= first) & (split >= 0))
            mine, which, edge = of[on], split[on], cut.take(of[on])
            cell = np.empty(len(on), np.uint8)
            for c in np.unique(which):
                here = np.flatnonzero(which == c)
                cell[here] = columns[c].take(a + on[here])
            leaf[a + on] = child.take(mine) + (cell > edge)
        if level + 1 == depth:  # the last level needs its sums alone
            of = leaf.take(rows)
            half = int(np.searchsorted(rows, turn))
            new = np.arange(first, made)
            c0, c1 = (np.bincount(x, minlength=made)[first:] for x in (of[:half], of[half:]))
            w = scale[0] * c0 + scale[1] * c1
            value[new] = np.bincount(of, weights=weighted.take(rows), minlength=made)[first:] / np.where(w > 0, w, 1.0)
            break
        k = np.arange(len(parts))
        left_size = below.sum(axis=1)[f, parts, b]
        right_size = above.sum(axis=1)[f, parts, b]
        less = first + 2 * k + (right_size < left_size)
        place = np.full(made, -1, np.int32)
        place[less] = k
        of = place.take(leaf.take(rows))
        chosen = np.flatnonzero(of >= 0)
        got, got_sum = counted(rows[chosen], of[chosen], len(parts))
        rest, rest_sum = held[:, :, parts] - got, sums[:, parts] - got_sum
        is_left = (less == first + 2 * k)[:, None]
        held, sums = np.empty((width, 2, 2 * len(parts), BINS)), np.empty((width, 2 * len(parts), BINS))
        held[:, :, 0::2], held[:, :, 1::2] = np.where(is_left, got, rest), np.where(is_left, rest, got)
        sums[:, 0::2], sums[:, 1::2] = np.where(is_left, got_sum, rest_sum), np.where(is_left, rest_sum, got_sum)
        open_at = np.arange(first, made)
    return {"feature": feature[:made], "bin": cut[:made], "child": child[:made], "value": value[:made], "worth": worth[:made]}, leaf


# ---------------------------------------------------------------- fits
def _row(number: int, weight: float, tree: dict, cuts: list[np.ndarray]) -> pa.RecordBatch:
    """A tree as bytes: a leaf is its own child and no value passes its cut, so walks need no test for it."""
    inner = tree["feature"] >= 0
    cut = np.full(len(inner), np.inf)
    edges = np.concatenate(cuts) if cuts else np.zeros(0)
    begin = np.cumsum([0, *[len(c) for c in cuts]])
    cut[inner] = edges[begin[tree["feature"][inner]] + tree["bin"][inner]]
    gains = np.bincount(tree["feature"][inner], weights=tree["worth"][inner], minlength=len(cuts))
    arrays = (np.where(inner, tree["feature"], 0).astype("<i4"), cut.astype("<f8"), np.where(inner, tree["child"], np.arange(len(inner))).astype("<i4"), tree["value"].astype("<f8"))
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int32()), pa.array([float(weight)]), *[pa.array([a.tobytes()], pa.binary()) for a in arrays], pa.array([gains.tolist()], pa.list_(pa.float64()))],
        names=["tree", "weight", "feature", "cut", "child", "value", "gains"],
    )


def _grown(train: DataFrame, features: Sequence[str], target: str, classes: dict, weights: tuple[float, float], tasks: Callable, grow: Callable, each: bool) -> dict:
    """Bin, grow and store the trees; what scoring and importances need of them."""
    spark = train.sparkSession
    source, path = _binned(train, features, target, weights, sum(classes.values())), new_path(spark, "trees")

    def run(batches):
        yield from grow(source, [i for batch in batches for i in batch.column("id").to_pylist()])

    _small_groups(tasks(spark).mapInArrow(run, TREES)).parquet(path)
    found = bounded_collect(spark.read.parquet(path).select("tree", "gains").orderBy("tree"))
    total = np.zeros(len(features))
    for r in found:
        gains = np.array(r["gains"])
        total += gains / (gains.sum() or 1.0) if each else gains
    return {"trees": path, "count": len(found), "importance": [float(v) for v in total / (total.sum() or 1.0)]}


def fit_forest(train: DataFrame, features: Sequence[str], target: str, classes: dict, weights: tuple[float, float], params: dict, seed: int) -> dict:
    trees, depth, least = int(params["numTrees"]), int(params["maxDepth"]), int(params.get("minInstancesPerNode", 1))
    if trees < 1 or not 0 <= depth <= 30 or least < 1:
        raise ValueError(f"no forest has the parameters {params}")
    asked = len(features) if trees == 1 else math.ceil(math.sqrt(len(features)))
    scale = np.array(weights, float)

    def grow(source: str, numbers: list[int]) -> Iterator[pa.RecordBatch]:
        if numbers:
            columns, label, cuts = _loaded(source)
            width, usable = len(columns), np.flatnonzero([len(c) > 0 for c in cuts])
            flat = np.empty((len(label), width), np.uint8)
            for i in range(width):
                flat[:, i], columns[i] = columns[i], None
            flat = flat.ravel()
            for t in numbers:
                yield _row(t, 1.0, grow_classifier(flat, width, label, usable, asked, scale, depth, least, np.random.default_rng([seed, t])), cuts)

    tasks = lambda spark: spark.range(0, trees, 1, min(trees, 2 * spark.sparkContext.defaultParallelism))
    return {**_grown(train, features, target, classes, weights, tasks, grow, True), "link": "mean"}


def fit_boosted(train: DataFrame, features: Sequence[str], target: str, classes: dict, weights: tuple[float, float], params: dict, seed: int) -> dict:
    """Logistic loss on labels of -1 and 1; the first tree counts whole, each later one by the step."""
    rounds, depth, least = int(params["maxIter"]), int(params["maxDepth"]), int(params.get("minInstancesPerNode", 1))
    step, share = float(params.get("stepSize", 0.1)), float(params.get("subsamplingRate", 1.0))
    if rounds < 1 or not 0 <= depth <= 30 or least < 1 or not 0 < step <= 1 or not 0 < share <= 1:
        raise ValueError(f"no boosted trees have the parameters {params}")
    scale = np.array(weights, float)

    def grow(source: str, numbers: list[int]) -> Iterator[pa.RecordBatch]:
        if not numbers:
            return
        columns, label, cuts = _loaded(source)
        turn = int(np.searchsorted(label, 1))
        classes = ((slice(0, turn), -1.0, scale[0]), (slice(turn, len(label)), 1.0, scale[1]))
        margin, weighted = np.zeros(len(label)), np.empty(len(label))
        for part, sign, weight in classes:
            weighted[part] = sign * weight
        for t in range(rounds):
            rng = np.random.default_rng([seed, t])
            rows = np.flatnonzero(rng.random(len(label)) < share) if share < 1 else np.arange(len(label))
            tree, leaf = grow_regressor(columns, turn, weighted, scale, rows, depth, least)
            by = 1.0 if t == 0 else step
            margin += by * tree["value"].take(leaf)
            with np.errstate(over="ignore"):
                for part, sign, weight in classes:
                    weighted[part] = 4.0 * sign * weight / (1.0 + np.exp(2.0 * sign * margin[part]))
            yield _row(t, by, tree, cuts)

    tasks = lambda spark: spark.range(0, 1, 1, 1)
    return {**_grown(train, features, target, classes, weights, tasks, grow, False), "link": "logistic"}


# ---------------------------------------------------------------- scores
def _stored_trees(path: str):
    for f in _files(path):
        for batch in f.iter_batches(batch_size=4, columns=["weight", "feature", "cut", "child", "value"]):
            for i in range(batch.num_rows):
                yield batch.column("weight")[i].as_py(), *[np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("feature", "<i4"), ("cut", "<f8"), ("child", "<i4"), ("value", "<f8"))]


def _walked(x: np.ndarray, path: str) -> np.ndarray:
    """Weighted sum of the trees' values for each row."""
    flat, width, total = np.ascontiguousarray(x).ravel(), x.shape[1], np.zeros(len(x))
    begin = np.arange(len(x)) * width
    for weight, feature, cut, child, value in _stored_trees(path):
        at = np.zeros(len(x), np.int64)
        while True:
            down = child.take(at) + (flat.take(begin + feature.take(at)) > cut.take(at))
            if (down == at).all():
                break
            at = down
        total += weight * value.take(at)
    return total


def probability(df: DataFrame, features: Sequence[str], fitted: dict):
    """Probability of class 1 as a column; a row with a gap is an error."""
    path, count, link = fitted["trees"], fitted["count"], fitted["link"]

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        def scored(held: list[np.ndarray]) -> Iterator[pd.Series]:
            x = np.concatenate(held)
            if np.isnan(x).any():
                raise ValueError("values to score cannot be null or NaN")
            total = _walked(x, path)
            with np.errstate(over="ignore"):
                p = total / count if link == "mean" else 1.0 / (1.0 + np.exp(-2.0 * total))
            yield from (pd.Series(part) for part in np.split(p, np.cumsum([len(h) for h in held])[:-1]))

        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in batch]))
            if sum(map(len, held)) >= SCORED:
                yield from scored(held)
                held = []
        if held:
            yield from scored(held)

    return score(*[F.col(f"`{c}`").cast("double") for c in features])
