"""Augmented views, embedding statistics, projections, probes and neighbours on embeddings."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import augment as a
from ..operators import metrics as mt
from ..operators import models as md
from ..operators import neighbors as nb
from ..operators.sampling import stratified_split
from ..operators.wide import array_width
from . import tables as t
from .registry import query
from .tables import r, sql_with

U = "((CAST('0x' || substr(md5('42:{0}:' || CAST(vec_id AS VARCHAR) || ':' || {1} || ':' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
CELLS = "cells AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings))"


def u(name, view="'0'"):
    return U.format(name, view)


def normal(name, view="'0'"):
    return f"(sqrt(-2.0 * ln({u(name + '/r', view)})) * cos({2.0 * math.pi!r}::DOUBLE * {u(name + '/a', view)}))"


def embeddings(spark, sf):
    return t.table(spark, sf, "embeddings")


def cells(df, x="embedding", keep=("vec_id",)):
    return df.select(*keep, F.posexplode(x).alias("i", "v")).withColumn("v", rounded("v"))


@query("feature_masking", sql_with(CELLS, body=f"SELECT vec_id, CAST(i AS INTEGER) AS i, {r(f'CASE WHEN {u("mask")} >= 0.15 THEN v ELSE 0 END')} AS v FROM cells"))
def _mask(spark, sf):
    return cells(embeddings(spark, sf).withColumn("embedding", a.feature_masking(F.col("embedding"), F.col("vec_id"))))


@query("feature_dropout", sql_with(CELLS, body=f"SELECT vec_id, CAST(i AS INTEGER) AS i, {r('CASE WHEN ' + u('dropout') + ' >= 0.1 THEN v ELSE 0 END')} AS v FROM cells"))
def _dropout(spark, sf):
    return cells(embeddings(spark, sf).withColumn("embedding", a.feature_dropout(F.col("embedding"), F.col("vec_id"))))


@query("gaussian_noise", sql_with(CELLS, body=f"SELECT vec_id, CAST(i AS INTEGER) AS i, {r('v + ' + normal('noise') + ' * 0.1')} AS v FROM cells"))
def _noise(spark, sf):
    return cells(embeddings(spark, sf).withColumn("embedding", a.gaussian_noise(F.col("embedding"), F.col("vec_id"))))


@query("random_corruption", sql_with(CELLS, body=f"SELECT vec_id, CAST(i AS INTEGER) AS i, {r('CASE WHEN ' + u('corrupt') + ' < 0.1 THEN ' + normal('corrupt') + ' ELSE v END')} AS v FROM cells"))
def _corrupt(spark, sf):
    return cells(embeddings(spark, sf).withColumn("embedding", a.random_corruption(F.col("embedding"), F.col("vec_id"))))


@query(
    "augmented_views",
    sql_with(
        CELLS,
        body=f"SELECT vec_id, CAST(view AS INTEGER) AS view, CAST(i AS INTEGER) AS i, {r('CASE WHEN ' + u('mask', 'CAST(view AS VARCHAR)') + ' >= 0.15 THEN v ELSE 0 END + ' + normal('noise', 'CAST(view AS VARCHAR)') + ' * 0.1')} AS v FROM cells, (SELECT unnest([0, 1]) AS view)",
    ),
)
def _views(spark, sf):
    return cells(a.views(embeddings(spark, sf).select("vec_id", "embedding"), "vec_id", "embedding"), keep=("vec_id", "view"))


HASH = "CAST('0x' || substr(md5('42:{0}:' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT)"


@query(
    "column_shuffle",
    sql_with(
        f"placed AS (SELECT vec_id, embedding, {HASH.format('batch')} % CAST(ceil((SELECT COUNT(*) FROM embeddings) / 256.0) AS BIGINT) AS b FROM embeddings)",
        f"x AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY b ORDER BY {HASH.format('order')}, vec_id) AS p1, ROW_NUMBER() OVER (PARTITION BY b ORDER BY {HASH.format('partner')}, vec_id) AS p2 FROM placed)",
        "cells AS (SELECT vec_id, i, e[i + 1]::DOUBLE AS v, o[i + 1]::DOUBLE AS w FROM (SELECT l.vec_id, l.embedding AS e, q.embedding AS o, unnest(range(len(l.embedding))) AS i FROM x l JOIN x q ON l.b = q.b AND l.p1 = q.p2))",
        body=f"SELECT vec_id, CAST(i AS INTEGER) AS i, {r('CASE WHEN ' + u('swap') + ' < 0.1 THEN w ELSE v END')} AS v FROM cells",
    ),
)
def _shuffle(spark, sf):
    return cells(a.column_shuffle(embeddings(spark, sf).select("vec_id", "embedding"), "vec_id", "embedding"))


@query("mixup")
def _mixup(spark, sf):
    return cells(a.mixup(embeddings(spark, sf).select("vec_id", "embedding"), "vec_id", "embedding"))


@query(
    "embedding_statistics",
    sql_with(
        CELLS,
        body=f"""SELECT (SELECT COUNT(*) FROM embeddings) AS n_samples, CAST((SELECT MAX(len(embedding)) FROM embeddings) AS INTEGER) AS dim, {r('AVG(v)')} AS mean, {r('stddev_pop(v)')} AS std, {r('MIN(v)')} AS min, {r('MAX(v)')} AS max,
          (SELECT {r('AVG(n)')} FROM (SELECT sqrt(SUM(v * v)) AS n FROM cells GROUP BY vec_id)) AS mean_l2_norm, (SELECT {r('stddev_pop(n)')} FROM (SELECT sqrt(SUM(v * v)) AS n FROM cells GROUP BY vec_id)) AS std_l2_norm FROM cells""",
    ),
)
def _stats(spark, sf):
    out = a.embedding_statistics(embeddings(spark, sf), "embedding")
    return out.withColumns({c: rounded(c) for c in ("mean", "std", "min", "max", "mean_l2_norm", "std_l2_norm")})


@query(
    "similarity_matrix",
    sql_with(
        "s AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY CAST('0x' || substr(md5('42:' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT), vec_id LIMIT 200)",
        body=f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, {r('list_cosine_similarity(a.e, b.e)')} AS similarity FROM s a, s b",
    ),
)
def _similarity(spark, sf):
    return a.similarity_matrix(embeddings(spark, sf), "vec_id", "label", "embedding").withColumn("similarity", rounded("similarity"))


@query(
    "embedding_histogram",
    sql_with(
        CELLS, "norms AS (SELECT sqrt(SUM(v * v)) AS v FROM cells GROUP BY vec_id)",
        body=" UNION ALL ".join(
            f"SELECT '{k}' AS kind, CAST(least(floor((v - lo) * {b}.0::DOUBLE / (hi - lo)), {b - 1}) AS INTEGER) AS bin, COUNT(*) AS n FROM {c}, (SELECT MIN(v) AS lo, MAX(v) AS hi FROM {c}) GROUP BY 2"
            for k, b, c in (("value", 60, "cells"),)
        ),
    ),
)
def _histogram(spark, sf):
    return a.embedding_histogram(embeddings(spark, sf), "embedding").filter(F.col("kind") == "value")


@query("embedding_norm_histogram")
def _norm_histogram(spark, sf):
    # unit-length rows differ only in the last digit, so bins are not comparable across engines
    return a.embedding_histogram(embeddings(spark, sf), "embedding").filter(F.col("kind") == "norm")


@query("embedding_plane")
def _plane(spark, sf):
    df = embeddings(spark, sf)
    dim = array_width(df, "embedding")
    wide = df.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"z_{i:03d}") for i in range(dim)])
    out = md.apply_projection(wide, md.fit_pca(wide, [f"z_{i:03d}" for i in range(dim)], k=2))
    return out.select("vec_id", "label", rounded("pca__1", 4).alias("pc1"), rounded("pca__2", 4).alias("pc2"))


def labelled(spark, sf):
    base = embeddings(spark, sf).select("vec_id", "embedding", F.when(F.col("label") == 0, 1).otherwise(0).alias("target"))
    return t.stored(spark, sf, "labelled_embeddings", lambda s, d: stratified_split(base, "target", "vec_id"))


LABELLED = """lab0 AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN label = 0 THEN 1 ELSE 0 END AS target FROM embeddings),
lab AS MATERIALIZED (SELECT vec_id, e, target, CASE WHEN rn <= floor(n * 0.15 + 0.5) THEN 'test' WHEN rn <= 2 * floor(n * 0.15 + 0.5) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, COUNT(*) OVER (PARTITION BY target) AS n,
  ROW_NUMBER() OVER (PARTITION BY target ORDER BY CAST('0x' || substr(md5('42:' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT), vec_id) AS rn FROM lab0)),
near AS (SELECT * FROM (SELECT q.vec_id, q.split, q.target, d.target AS vote, list_distance(q.e, d.e) AS dist, ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, d.e), d.vec_id) AS rn
  FROM lab q JOIN lab d ON q.split <> 'train' AND d.split = 'train') WHERE rn <= 15)"""


def _sides(spark, sf):
    df = labelled(spark, sf)
    vec = F.col("embedding").cast("array<double>").alias("vec")
    queries = df.filter(F.col("split") != "train").select(F.col("vec_id").alias("id"), vec)
    refs = df.filter(F.col("split") == "train").select(F.col("vec_id").alias("id"), vec, F.col("target").cast("double").alias("payload"))
    return df, queries, refs


@query("nearest_neighbour_probe", sql_with(LABELLED, body=f"SELECT vec_id AS id, {r('AVG(vote)')} AS p FROM near GROUP BY vec_id"))
def _probe(spark, sf):
    _, queries, refs = _sides(spark, sf)
    return nb.knn_probability(queries, refs, 15).withColumn("p", rounded("p"))


@query("nearest_neighbour_classifier", sql_with(LABELLED, body=f"SELECT vec_id AS id, {r('SUM(vote / dist) / SUM(1 / dist)')} AS p FROM near GROUP BY vec_id"))
def _classifier(spark, sf):
    _, queries, refs = _sides(spark, sf)
    return nb.knn_probability(queries, refs, 15, weights="distance").withColumn("p", rounded("p"))


@query(
    "nearest_neighbour_probe_metrics",
    sql_with(
        LABELLED, "p AS (SELECT vec_id, split, target AS y, AVG(vote) AS p FROM near GROUP BY vec_id, split, target)",
        body=f"""SELECT split, COUNT(*) FILTER (y = 0 AND p < 0.5) AS tn, COUNT(*) FILTER (y = 0 AND p >= 0.5) AS fp, COUNT(*) FILTER (y = 1 AND p < 0.5) AS fn, COUNT(*) FILTER (y = 1 AND p >= 0.5) AS tp, {r('AVG((p - y) ** 2)')} AS brier_score FROM p GROUP BY split""",
    ),
)
def _probe_metrics(spark, sf):
    df, queries, refs = _sides(spark, sf)
    scored = df.join(nb.knn_probability(queries, refs, 15), F.col("vec_id") == F.col("id"))
    return mt.evaluate(scored, 0.5, "target", "p", by=["split"]).select("split", "tn", "fp", "fn", "tp", rounded("brier_score").alias("brier_score"))


@query("linear_probe")
def _linear(spark, sf):
    threshold, ev = md.linear_probe(labelled(spark, sf), "embedding", "target", "vec_id")
    rows = [(s, float(threshold), float(m["roc_auc"]), float(m["f1"])) for s, m in ev.items()]
    return spark.createDataFrame(rows, "split string, threshold double, roc_auc double, f1 double")
