"""Whitened embeddings through Spark MLlib's BlockMatrix.

1. Components become integers x = floor(scale * c) + shift; the fit list holds each different x once.
2. Centring is exact: n * x - S is an integer (S the sums over the fit list), divided by n once.
3. Centred rows of the fit list are indexed densely and dealt into blocks of a BlockMatrix. Its transpose
   times itself, the middle dimension split over many tasks, is the scatter: one small block.
4. The covariance's eigenvectors (local, a matrix of dimension by dimension) over the square roots of their
   eigenvalues make the whitening matrix; BlockMatrix multiplication projects the rows with it.
5. The projected fit list, transposed and multiplied with itself, tells how far its covariance is from the
   identity.

The driver holds matrices of dimension by dimension and the places of the blocks, never rows.

Defined cases: rows with a null vector or a null or non-finite entry are dropped; a null id stays a null id;
a shorter vector counts as if filled up with zeros; repeated rows each get their result, the vector counts
once in the fit list; a component without variance (an eigenvalue that is zero to double precision) has a
null `whitened` and takes no part in identity_error; without any component of variance identity_error is
zero; explained is 0 when the trace is; a deviation beyond 64 bits is null; no row gives no row; only the
named columns are read.
"""
from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

ROWS_PER_BLOCK = 2_048
BLOCKS_PER_TASK = 8
_PLACE = (1 << 33) - 1  # bits that count rows within a partition in monotonically_increasing_id


def dense_index(df: DataFrame, label: str) -> DataFrame:
    """The rows of a written table with `index` 0, 1, … and written again. One count per partition reaches the driver."""
    spark = df.sparkSession
    numbered = df.withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33))
    sizes = sorted((r["_part"], r["count"]) for r in numbered.groupBy("_part").count().collect())
    begins, total = [], 0
    for part, size in sizes:
        begins.append((part, total))
        total += size
    offsets = spark.createDataFrame(begins, "_part long, _begin long")  # one row per partition of the scan
    placed = numbered.join(F.broadcast(offsets), "_part").withColumn("index", F.col("_begin") + F.col("_place").bitwiseAND(F.lit(_PLACE)))
    out = materialize(placed.drop("_place", "_part", "_begin"), label)
    seen = out.agg(F.count("*").alias("n"), F.min("index").alias("low"), F.max("index").alias("high"), F.sum(F.col("index").cast("decimal(38,0)")).alias("sum")).first()
    if total and (seen["n"], seen["low"], seen["high"], int(seen["sum"])) != (total, 0, total - 1, total * (total - 1) // 2):
        raise RuntimeError("the table was read in another order the second time; its rows have no dense index")
    return out


def block_matrix(indexed: DataFrame, values: Column, rows: int, dims: int) -> BlockMatrix:
    vectors = indexed.select("index", array_to_vector(values).alias("row"))
    # Products read the blocks several times; without this each time deals all rows into blocks anew. A lost block is made again.
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "row"), rows, dims).toBlockMatrix(ROWS_PER_BLOCK, dims).persist(StorageLevel.MEMORY_AND_DISK)


def gram(matrix: BlockMatrix, rows: int) -> np.ndarray:
    """Transpose times the matrix itself, as a local array. The middle dimension is split, so no task holds all blocks."""
    splits = max(1, -(-rows // (ROWS_PER_BLOCK * BLOCKS_PER_TASK)))
    java = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def whitening_matrix(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, whether each is above zero, and the scaled eigenvectors as columns (zero for the others)."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    alive = values > len(covariance) * np.finfo(float).eps * max(values[0], 0.0)
    return values, alive, np.where(alive, vectors / np.sqrt(np.where(alive, values, 1.0)), 0.0)


def whiten(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", scale: float = 64.0, shift: int = 1_000_000, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable row and component."""
    spark = df.sparkSession
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    x = F.transform(vector, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")) + F.lit(int(shift)).cast("long"))
    usable = df.where(F.col(vector).isNotNull() & finite).select(F.col(ident).alias("vec_id"), x.alias("x"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = materialize(usable, "whitening-rows")
    dims = rows.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0
    if not dims:  # no row, or empty vectors alone
        return spark.createDataFrame([], schema)
    filled = F.concat("x", F.array_repeat(F.lit(int(shift)).cast("long"), F.lit(dims) - F.size("x")))
    rows = dense_index(rows.withColumn("x", filled), "whitening-index")
    fit = dense_index(materialize(rows.select("x").distinct(), "whitening-fit"), "whitening-fit-index")
    total = rows.count()
    sums = fit.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]).first()
    n, s = sums["n"], [int(sums[f"s{i}"]) for i in range(dims)]

    sums_column = F.array(*[F.lit(v).cast("long") for v in s])
    gap = F.zip_with("x", sums_column, lambda a, b: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), a), b))
    centred = F.zip_with("x", sums_column, lambda a, b: (F.lit(n).cast("long") * a - b).cast("double") / F.lit(float(n)))
    deviation = F.aggregate(gap, F.lit(0).cast("long"), lambda acc, v: F.try_add(acc, F.try_multiply(v, v)))

    fitted = block_matrix(fit, centred, n, dims)
    covariance = gram(fitted, n) / n
    values, alive, white = whitening_matrix(covariance, min(components, dims))
    count = len(values)
    by = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, count, white.ravel(order="F")))], 1), dims, count)
    spread = gram(fitted.multiply(by).persist(StorageLevel.MEMORY_AND_DISK), n) / n
    error = float(np.abs(spread - np.eye(count))[np.ix_(alive, alive)].max()) if alive.any() else 0.0
    trace = float(np.trace(covariance))
    explained = [float(max(v, 0.0) / trace) if trace > 0 else 0.0 for v in values]

    projected = block_matrix(rows, centred, total, dims).multiply(by).toIndexedRowMatrix()
    scores = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model), "vector")
    scores = scores.select("index", vector_to_array("vector").alias("scores"))
    placed = rows.select("vec_id", "index", deviation.alias("deviation")).join(scores, "index")
    shown = placed.select("vec_id", "deviation", F.posexplode("scores").alias("at", "score"))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("at") + 1)
    return shown.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(pick([bool(a) for a in alive]), F.col("score")).alias("whitened"), pick(explained).alias("explained"), F.lit(error).alias("identity_error"),
    )
