"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: the letters of a text, lowered, everything else a space; its runs of 1 to 3 characters
  are hashed into `buckets` cells. tf is the share of a cell among the text's runs.
* idf comes from one pass over every learning row (a count per cell, summed by Spark).
* Weights: follow-the-regularised-leader with per-coordinate rates, L1 and L2, on a sample of about
  `per_language` rows of each language, drawn by a hash of the id. The bound is the parameter.
* Calibration: one temperature, fitted on the quarter of the sample kept out of the training.

Defined cases: null text or a text without a letter is `und` with score 0; rows with a null label or
id are never learned from; with no labelled row at all everything is `und`; with equal scores the
language that sorts first wins; equal texts get equal answers; predicted columns replace input
columns of the same name, all other columns are passed through untouched.
"""
from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_collect
from .words import chunked, mixed

UNKNOWN = "und"
BUCKETS = 1 << 17
PER_LANGUAGE = 1_500
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 3
TF_SCALE = 40.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point the lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _cells(text: str, buckets: int) -> np.ndarray:
    """Cell of each run of 1 to 3 characters; none if there is no letter."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (points != 32).any():
        return np.zeros(0, np.int64)
    c = points.astype(np.uint64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:] if len(c) > 2 else np.zeros(0, np.uint64)
    # spaces alone say nothing; the length of a run is part of its code, since code points fill 21 bits
    runs = np.concatenate([c[c != 32], two + (np.uint64(1) << np.uint64(63)), three])
    return (mixed(runs) & np.uint64(buckets - 1)).astype(np.int64)


def _texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column.cast(pa.string()), "").to_pylist()


def _frequencies(buckets: int):
    """Per task: in how many texts each cell occurs, and as cell -1 the number of texts."""
    def run(batches):
        seen, texts = np.zeros(buckets, np.int64), 0
        for batch in chunked(batches, "text"):
            for text in _texts(batch.column("text")):
                cells = _cells(text, buckets)
                if len(cells):
                    seen[np.unique(cells)] += 1
                    texts += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], texts))], names=["cell", "n"])

    return run, "cell long, n long"


def _tf(text: str, buckets: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cells = _cells(text, buckets)
    at, count = np.unique(cells, return_counts=True)
    return at, count * idf[at] * (TF_SCALE / max(1, len(cells)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_weights(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, buckets: int, epochs: int = EPOCHS) -> np.ndarray:
    """Follow-the-regularised-leader over (cells, values, class): weights of shape (buckets, classes), exact zeros where L1 holds."""
    z, n = np.zeros((buckets, classes)), np.zeros((buckets, classes))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2)), nn

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, label = rows[k]
            if not len(at):
                continue
            w, nn = weights(at)
            p = _softmax(x @ w)
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            g2 = g * g
            z[at] += g - (np.sqrt(nn + g2) - np.sqrt(nn)) / ALPHA * w
            n[at] += g2
    return weights(slice(None))[0]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood on held-back rows."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(-4, 3, 141))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class LanguageModel:
    def __init__(self, languages: list[str], table: np.ndarray, temperature: float, buckets: int):
        self.languages, self.table, self.temperature, self.buckets = languages, table, temperature, buckets

    def predict_texts(self, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for text in texts:
            cells = _cells(text, self.buckets) if text and self.languages else ()
            if not len(cells):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            # a long text is summed by cell, so that no row of weights is copied for each of its runs
            total = self.table[cells].sum(axis=0, dtype=np.float64) if len(cells) < self.buckets else np.bincount(cells, minlength=self.buckets) @ self.table.astype(np.float64)
            logits = total * (TF_SCALE / len(cells))
            p = _softmax(logits / self.temperature)
            best = int(np.argmax(p))
            names.append(self.languages[best])
            scores.append(float(p[best]))
        return names, scores

    def predict(self, docs: DataFrame, text: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
        """All columns of docs, and the predicted language and its calibrated probability."""
        kept = [c for c in docs.columns if c not in (language, score)]
        rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("text"))
        blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(self))
        outputs = [*rows.schema.fields[:-1]]

        def run(batches):
            model = pickle.loads(blob.value)
            for batch in chunked(batches, "text"):
                names, scores = model.predict_texts(_texts(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "p_lang", "p_score"])

        from pyspark.sql.types import DoubleType, StringType, StructField, StructType

        done = rows.mapInArrow(run, StructType([*outputs, StructField("p_lang", StringType()), StructField("p_score", DoubleType())]))
        return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("p_lang").alias(language), F.col("p_score").alias(score))


def fit(docs: DataFrame, learn: Column, ident: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, buckets: int = BUCKETS) -> LanguageModel:
    """Learn from the rows where `learn` holds and the label is not null."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in bounded_collect(rows.groupBy("lang").count())}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), 1.0, buckets)

    found = bounded_collect(rows.select("text").mapInArrow(*_frequencies(buckets)).groupBy("cell").agg(F.sum("n").alias("n")), buckets + 1)
    seen, texts = np.zeros(buckets), 0
    for r in found:
        if r["cell"] < 0:
            texts = r["n"]
        else:
            seen[r["cell"]] = r["n"]
    idf = np.log((1 + texts) / (1 + seen)) + 1

    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))])
    draw = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.where(draw < share[F.col("lang")]).withColumn("order", F.xxhash64("id", "text"))
    # the scan keeps its tasks, only the bounded sample moves to the one that learns
    sample = sample.select("order", "text", "lang").repartition(1)

    def learn_rows(batches):
        data = []
        for batch in chunked(batches, "text"):
            for order, text, label in zip(batch.column("order").to_pylist(), _texts(batch.column("text")), batch.column("lang").to_pylist()):
                at, x = _tf(text, buckets, idf)
                data.append((order, at.astype(np.int32), x.astype(np.float32), languages.index(label)))
        data.sort(key=lambda r: r[0])
        rows = [r[1:] for r in data]
        kept_back = rows[::4] if len(rows) >= 8 else []
        w = train_weights([r for i, r in enumerate(rows) if i % 4] if kept_back else rows, len(languages), buckets)
        logits = np.array([x @ w[at] for at, x, _ in kept_back]).reshape(-1, len(languages))
        heat = fit_temperature(logits, np.array([r[2] for r in kept_back], int))
        yield pa.RecordBatch.from_arrays([pa.array([(w * idf[:, None]).astype(np.float32).tobytes()], pa.binary()), pa.array([heat])], names=["table", "heat"])

    fitted = sample.mapInArrow(learn_rows, "table binary, heat double").first()
    return LanguageModel(languages, np.frombuffer(fitted["table"], np.float32).reshape(buckets, len(languages)), fitted["heat"], buckets)
