"""Quality scores by a regularised quadratic discriminant over document statistics.

1. Statistics: counts over the bytes, words, lines and word runs of the whole text (`NAMES`), each made
   roughly normal: sizes by a logarithm, shares by a logit.
2. Sample: about `per_label` labelled rows of each label, drawn by a hash of the id (the documented
   bound). Only their statistics reach the driver.
3. Classes: mean and covariance of each label. A covariance is drawn towards the pooled one (`share`) and
   towards a multiple of the identity (`ridge`); both amounts are those with the least log loss over
   `FOLDS` folds of the sample. Each covariance is kept as the inverse of its Cholesky factor and its log
   determinant, so that a text costs one small product per class.
4. Score: the difference of the two Mahalanobis log densities, its tails drawn in, made a probability by a logistic curve
   fitted to the held-out differences of the folds, weighted to the share each label has among all rows
   learned from.

Defined cases: a null text counts as empty, an empty text has the statistics of no words and is scored
like any other; rows with a null label or id are never learned from; repeated documents and labels are learned
once; with fewer than two rows of either label every score is the share of label 1 (one half without any
label); repeated rows get equal answers; only the named columns are read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_collect, materialize
from .words import chunked, flat_bytes, row_id, run_hashes, shown_id, text_bytes, word_hashes, word_spans

PER_LABEL = 10_000
FOLDS = 5
SHARES = (0.0, 0.05, 0.2, 0.5, 0.8)
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1, 0.3)

NAMES = (
    "words", "word_bytes", "words_a_line", "capitals", "digits", "symbols", "marks", "not_ascii",
    "distinct_words", "commonest_word", "same_as_before", "distinct_pairs", "repeated_threes", "repeated_lines", "lone_signs", "odd_ends",
)

_KIND = np.zeros(256, np.int64)  # 0 white or control, 1 small letter, 2 capital, 3 digit, 4 mark of a sentence, 5 symbol, 6 not ASCII
_KIND[33:127] = 5
_KIND[list(b".,;:?!'\"()-")] = 4
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 3, 2, 1, 6


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Logit of part / whole, kept finite at 0 and 1."""
    share = np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)
    return np.log((share + 0.002) / (1.002 - share))


def _repeats(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per owner: how many hashes differ, how often its commonest one stands, and how many entries are no first of their kind."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    distinct, most = np.bincount(o[first], minlength=n), np.zeros(n, np.int64)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(o))))
    return distinct, most, np.bincount(o, minlength=n) - distinct


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row per text, one column per entry of NAMES."""
    n = len(texts)
    data, bounds = flat_bytes(texts)
    starts, ends, firsts = word_spans(data, bounds)
    sizes = np.diff(firsts)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(np.repeat(np.arange(n), np.diff(bounds)) * 7 + _KIND[data], minlength=7 * n).reshape(n, 7)
    small, capital, digit, mark, symbol, other = kinds[:, 1:].T
    seen = kinds[:, 1:].sum(axis=1)

    words = word_hashes(data, starts, ends)
    distinct, most, _ = _repeats(owner, words, n)
    same = np.zeros(n, np.int64)
    if len(words) > 1:
        again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        same = np.bincount(owner[1:][again], minlength=n)

    def runs(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct and repeated runs of k words that stay in one text."""
        hashes = run_hashes(words, k)
        whole = owner[k - 1 :][: len(hashes)] == owner[: len(hashes)]
        out = _repeats(owner[: len(hashes)][whole], hashes[whole], n)
        return out[0], out[2]

    pairs, _ = runs(2)
    _, threes = runs(3)
    per_line = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    lines = np.array([len(x) for x in per_line], np.int64)
    lines_again = np.array([len(x) - len(set(x)) for x in per_line], np.int64)
    one = ends - starts == 1
    lone = np.bincount(owner[one & np.isin(_KIND[data[starts]], (4, 5))], minlength=n)
    odd = np.bincount(owner[_KIND[data[ends - 1]] == 5], minlength=n) if len(ends) else np.zeros(n, np.int64)

    columns = [
        np.log1p(sizes), np.log1p(seen / np.maximum(sizes, 1)), np.log1p(sizes / np.maximum(lines, 1)),
        _logit(capital, small + capital), _logit(digit, seen), _logit(symbol, seen), _logit(mark, seen), _logit(other, seen),
        _logit(distinct, sizes), _logit(most, sizes), _logit(same, sizes), _logit(pairs, np.maximum(sizes - 1, 0)),
        _logit(threes, np.maximum(sizes - 2, 0)), _logit(lines_again, lines), _logit(lone, sizes), _logit(odd, sizes),
    ]
    return np.column_stack(columns) if n else np.zeros((0, len(NAMES)))


class ClassDensity:
    """Normal density of one class, kept as its mean, the inverse of the covariance's Cholesky factor and the log determinant."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray):
        factor = np.linalg.cholesky(covariance)
        self.mean, self.inverse = mean, np.linalg.inv(factor)
        self.log_det = 2 * np.log(np.diag(factor)).sum()

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Up to the constant that all classes share."""
        return -0.5 * (((x - self.mean) @ self.inverse.T) ** 2).sum(axis=1) - 0.5 * self.log_det


def discriminant(x: np.ndarray, y: np.ndarray, share: float, ridge: float) -> tuple[ClassDensity, ClassDensity]:
    """Densities of label 0 and 1 with covariances (1 - ridge) * ((1 - share) * own + share * pooled) + ridge * identity."""
    parts = [x[y == k] for k in (0, 1)]
    own = [np.cov(p, rowvar=False, bias=True).reshape(x.shape[1], -1) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, own)) / len(x)
    mixed = [(1 - ridge) * ((1 - share) * c + share * pooled) + ridge * np.eye(x.shape[1]) for c in own]
    return ClassDensity(parts[0].mean(axis=0), mixed[0]), ClassDensity(parts[1].mean(axis=0), mixed[1])


def log_ratio(classes: tuple[ClassDensity, ClassDensity], x: np.ndarray) -> np.ndarray:
    return classes[1].log_density(x) - classes[0].log_density(x)


def squeezed(ratio: np.ndarray) -> np.ndarray:
    """Far tails drawn in, in unchanged order: normal densities overstate them."""
    return np.sign(ratio) * np.sqrt(np.abs(ratio))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve over z, by damped Newton steps."""
    a, w = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        s = a @ v
        return float((weight * (np.logaddexp(0, s) - y * s)).sum() + 5e-4 * weight.sum() * v[0] ** 2)

    for _ in range(rounds):
        p = _sigmoid(a @ w)
        grad = a.T @ (weight * (p - y)) + np.array([1e-3 * weight.sum() * w[0], 0.0])
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-3 * weight.sum(), 1e-9])
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    classes: tuple[ClassDensity, ClassDensity] | None
    curve: tuple[float, float]
    share: float = 0.0
    ridge: float = 0.0

    def score_statistics(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.curve[1])
        return _sigmoid(self.curve[0] * squeezed(log_ratio(self.classes, (x - self.centre) / self.scale)) + self.curve[1])

    def score(self, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per input row: doc_id, score, and the statistics as an array in the order of NAMES."""
        model = self

        def run(batches):
            for batch in chunked(batches, "text"):
                x = statistics(text_bytes(batch.column("text")))
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float64()), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score_statistics(x), pa.float64()), rows], names=["id", "score", "statistics"])

        rows = docs.select(row_id(ident).alias("id"), F.col(text).cast("string").alias("text"))
        done = rows.mapInArrow(run, "id long, score double, statistics array<double>")
        return done.withColumn("id", shown_id(F.col("id"))).withColumnRenamed("id", "doc_id")


def fit_sample(x: np.ndarray, y: np.ndarray, fold: np.ndarray, ones: float) -> QualityModel:
    """Choose the shrinkage over the folds, fit the curve to the held-out ratios, then fit the classes to all rows.
    `ones` is the share of label 1 among all rows learned from."""
    few = min((y == 0).sum(), (y == 1).sum()) if len(y) else 0
    if few < 2:
        return QualityModel(np.zeros(len(NAMES)), np.ones(len(NAMES)), None, (0.0, ones))
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = (x - centre) / scale
    weight = np.where(y == 1, ones / (y == 1).mean(), (1 - ones) / (y == 0).mean())
    parts = [k for k in range(FOLDS) if min(((fold != k) & (y == v)).sum() for v in (0, 1)) >= 2 and (fold == k).any()]
    best = (np.inf, SHARES[-1], RIDGES[-1], (1.0, 0.0))
    for share in SHARES if parts else ():
        for ridge in RIDGES:
            z, known = np.zeros(len(y)), np.isin(fold, parts)
            for k in parts:
                z[fold == k] = squeezed(log_ratio(discriminant(x[fold != k], y[fold != k], share, ridge), x[fold == k]))
            z = z[known]
            a, b = fit_curve(z, y[known], weight[known])
            p = np.clip(_sigmoid(a * z + b), 1e-9, 1 - 1e-9)
            loss = -(weight[known] * np.where(y[known] == 1, np.log(p), np.log(1 - p))).sum()
            best = min(best, (loss, share, ridge, (a, b)))
    _, share, ridge, curve = best
    return QualityModel(centre, scale, discriminant(x, y, share, ridge), curve, share, ridge)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, ident: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL) -> QualityModel:
    """Learn from the labelled rows for which `learn` (over the column id, as text) holds."""
    known = labels.select(F.col(ident).cast("long").alias("doc"), F.col(label).cast("int").alias("label")).where("doc is not null and label in (0, 1)")
    known = known.withColumn("id", F.col("doc").cast("string")).where(learn)
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(sizes.values())
    if not total:
        return QualityModel(np.zeros(len(NAMES)), np.ones(len(NAMES)), None, (0.0, 0.5))
    share = F.when(F.col("label") == 1, min(1.0, per_label / max(1, sizes.get(1, 0)))).otherwise(min(1.0, per_label / max(1, sizes.get(0, 0))))
    place = F.pmod(F.xxhash64("id", F.lit("quality sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = known.where(place < share).select("doc", "label", F.pmod(F.xxhash64("id", F.lit("quality fold")), F.lit(FOLDS)).cast("int").alias("fold"))
    # At most about 2 * per_label small rows: safe to broadcast at any size of the corpus.
    sample = docs.select(F.col(ident).cast("long").alias("doc"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "doc")

    def measure(batches):
        for batch in chunked(batches, "text"):
            x = statistics(text_bytes(batch.column("text")))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float64()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), rows, batch.column("label"), batch.column("fold")], names=["doc", "x", "label", "fold"])

    # Written first, as it is counted and sorted. A row that stands many times in documents is learned once.
    measured = materialize(sample.mapInArrow(measure, "doc long, x array<double>, label int, fold int").distinct(), "quality-sample")
    rows = bounded_collect(measured.orderBy("label", "fold", "x"), 4 * per_label + 1000)
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(NAMES))
    y, fold = np.array([r["label"] for r in rows], int), np.array([r["fold"] for r in rows], int)
    return fit_sample(x, y, fold, sizes.get(1, 0) / total)
