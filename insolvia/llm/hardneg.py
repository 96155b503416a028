"""Hard negatives of anchors by exact integer inner products, several candidates to a wide integer.

1. Components become integers, floor(scale * x). Rows that repeat (id, label, components) are one row.
2. Rows are dealt by a hash of all they hold into blocks of at most about `block_rows`, anchors into blocks
   of `ANCHOR_ROWS`; every anchor block meets every row block once, as a co-group of a few MB.
3. In a co-group the candidates' components, made non-negative by a bias, are laid side by side in fields
   of one wide integer, wide enough that no sum of products crosses into the next field. One
   multiplication per anchor component then multiplies all of them; shifts and masks give the fields
   back, and the known biases are taken off: the exact inner products. 64-bit words hold two and more
   fields; fields too wide for that go into longer integers.
4. First pass: per anchor the best rows of its label, a few per block, merged. Second pass: per anchor and
   positive score the best rows of other labels within the window below that score, merged alike.
   Blocks hand on at most k rows per anchor and bound, so no merged list grows with the table's groups.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part;
a shorter vector counts as if filled up with zeros; components beyond 64 bits after scaling, and scores
beyond 64 bits, are the nearest long; equal scores are ordered by id, then label and components; rows that
share an id but differ in label or vector are different rows; an anchor without another row of its label,
or a positive without a negative in its window, has no result rows; only the named columns are read.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

ANCHOR_ROWS = 1_024
LEAST_BLOCK, LARGEST_BLOCK = 1_024, 16_384
TILE = 64  # anchors worked on at once
TOP = (1 << 63) - 1


def block_size(rows: int) -> int:
    """Small tables make about 64 blocks, large ones blocks of LARGEST_BLOCK rows. Results do not depend on it."""
    return min(LARGEST_BLOCK, max(LEAST_BLOCK, rows // 64))


def pack(values: np.ndarray, width: int, fields: int) -> np.ndarray:
    """Rows of non-negative integers, `fields` rows to a word: row i in field i % fields of word i // fields."""
    rows = -(-len(values) // fields)
    padded = np.zeros((rows * fields, values.shape[1]), values.dtype)
    padded[: len(values)] = values
    words = np.zeros((rows, values.shape[1]), values.dtype)
    for k in range(fields):
        words |= padded[k::fields] << (width * k if values.dtype == object else np.uint64(width * k))
    return words


def inner_products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of int64 rows, anchors x rows, as int64 (the nearest long where they are beyond it)."""
    n, m, dims = len(rows), len(anchors), rows.shape[1]
    if not n or not m or not dims:
        return np.zeros((m, n), np.int64)
    low, high, a_low, a_high = int(rows.min()), int(rows.max()), int(anchors.min()), int(anchors.max())
    width = max(1, (dims * (high - low) * (a_high - a_low)).bit_length())
    small = width <= 32
    if small:  # two or more fields in a word of 64 bits
        kind, fields = np.uint64, 64 // width
        candidates, factors = (rows - low).astype(kind), (anchors - a_low).astype(kind)
        products = np.einsum("cd,ad->ac", pack(candidates, width, fields), factors)
    else:  # integers longer than the machine's words
        kind, fields = int, 8
        candidates, factors = rows.astype(object) - low, anchors.astype(object) - a_low
        products = factors @ pack(candidates, width, fields).T
    out = np.zeros((m, products.shape[1] * fields), np.int64 if small else object)
    for k in range(fields):
        out[:, k::fields] = (products >> kind(width * k)) & kind((1 << width) - 1)
    # What the biases added: rows = candidates + low, anchors = factors + a_low.
    of_rows, of_anchors = candidates.sum(axis=1), factors.sum(axis=1)
    if small and dims * max(abs(low), abs(high), 1) * max(abs(a_low), abs(a_high), 1) * 4 < TOP:
        return out[:, :n] + a_low * of_rows.astype(np.int64) + low * of_anchors.astype(np.int64)[:, None] + dims * low * a_low
    exact = out[:, :n].astype(object) + a_low * of_rows.astype(object) + low * of_anchors.astype(object)[:, None] + dims * low * a_low
    return np.clip(exact, -TOP, TOP).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, larger first, equal ones in their order."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > cut), np.flatnonzero(scores == cut)
        places = np.concatenate([above, level[: k - len(above)]])
        places.sort()
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of longs as a matrix; shorter ones are filled up with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return np.zeros((0, 0), np.int64)
    if sizes.min() == sizes.max():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), sizes.max()), np.int64)
    out[np.arange(sizes.max()) < sizes[:, None]] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (a, b))


def _block(rows: pa.Table):
    """ids, labels and vectors of a block, in the order in which equal scores stand."""
    ids, labels, x = rows.column("id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("x"))
    order = np.lexsort((*x.T[::-1], labels, ids))
    return ids[order], labels[order], x[order]


def _own(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, ident, label, vector: np.ndarray) -> np.ndarray:
    """Places of the anchor itself among the rows."""
    same = np.flatnonzero((ids == ident) & (labels == label))
    return same[(x[same] == vector).all(axis=1)]


def positives_of(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            ids, labels, x = _block(rows)
            x, ax = _same_width(x, _matrix(anchors.column("a_x")))
            keys, part = anchors.column("a_key").to_pylist(), rows.column("part")[0].as_py()
            a_ids, a_labels = anchors.column("a_id").to_numpy(), anchors.column("a_label").to_numpy()
            for label in np.unique(a_labels):
                at, mine = np.flatnonzero(labels == label), np.flatnonzero(a_labels == label)
                for tile in (mine[i : i + TILE] for i in range(0, len(mine), TILE)):
                    for a, scores in zip(tile, inner_products(x[at], ax[tile])):
                        own = _own(ids[at], labels[at], x[at], a_ids[a], label, ax[a])
                        places = np.delete(np.arange(len(at)), own)
                        places = places[best(scores[places], k)]
                        out += zip([keys[a]] * len(places), [part] * len(places), ids[at][places].tolist(), scores[places].tolist())
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "part", "id", "score"])

    return run, "key string, part long, id long, score long"


def negatives_of(k: int, percent: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and anchors.num_rows:
            ids, labels, x = _block(rows)
            x, ax = _same_width(x, _matrix(anchors.column("a_x")))
            keys, bounds, part = anchors.column("a_key").to_pylist(), anchors.column("a_bounds").to_pylist(), rows.column("part")[0].as_py()
            a_labels = anchors.column("a_label").to_numpy()
            for label in np.unique(a_labels):
                at, mine = np.flatnonzero(labels != label), np.flatnonzero(a_labels == label)
                for tile in (mine[i : i + TILE] for i in range(0, len(mine), TILE)):
                    for a, scores in zip(tile, inner_products(x[at], ax[tile])):
                        windows = [(-(-percent * p // 100), p) for p in bounds[a]]
                        near = np.flatnonzero((scores <= max(w[1] for w in windows)) & (scores >= min(w[0] for w in windows)))
                        for least, most in windows if len(near) else ():
                            places = near[(scores[near] >= least) & (scores[near] <= most)]
                            places = places[best(scores[places], k)]
                            out += zip([keys[a]] * len(places), [part] * len(places), [most] * len(places), ids[at][places].tolist(), scores[places].tolist())
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "part", "bound", "id", "score"])

    return run, "key string, part long, bound long, id long, score long"


def _merged(found: DataFrame, by: list[str], k: int, parts: int) -> DataFrame:
    """The first k of each group as an array `best` of (score, id), score negated; in two steps, so that no list holds more than
    k rows of each block of a part, then k rows of each part."""
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("score"), "id"))), 1, k)
    some = found.groupBy(*by, F.pmod("part", F.lit(parts)).alias("part")).agg(first.alias("best"))
    return some.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def usable_rows(df: DataFrame, ident: str, vector: str, label: str, scale: float) -> DataFrame:
    """id, label and integer components x of the rows that take part, repeated rows once."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    taken = F.col(ident).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite
    x = F.transform(vector, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return df.where(taken).select(F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x")).distinct()


def mine_hard_negatives(
    df: DataFrame, anchors: Column, ident: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, n_positives: int = 5,
    n_negatives: int = 5, percent: int = 80, block_rows: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `anchors` is a condition over the column id;
    a negative scores at least `percent` % of its positive and no more than it."""
    base = materialize(usable_rows(df, ident, vector, label, scale), "hard-negative-rows")
    size = base.count()
    rows_a_block = block_rows or block_size(size)
    blocks = max(1, -(-size // rows_a_block))
    parts = max(1, math.isqrt(blocks))
    place = F.xxhash64("id", "label", "x")
    # Two anchors that share an id must not be mixed up: the key is the anchor's whole row.
    key = F.concat_ws("-", "id", F.md5(F.concat_ws(",", "label", F.concat_ws(",", F.transform("x", lambda v: v.cast("string"))))))
    queries = base.where(anchors).withColumn("key", key)
    of = max(1, -(-queries.count() // ANCHOR_ROWS))
    queries = queries.withColumn("anchor_block", F.pmod(place, F.lit(of)))
    rows = base.withColumn("part", F.pmod(place, F.lit(blocks))).withColumn("anchor_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long"))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    def meet(asked: DataFrame, work) -> DataFrame:
        run, schema = work
        # Both sides come from one table: the anchors' columns get names of their own, or the co-group takes them for the rows'.
        named = asked.withColumn("part", every).select(*[F.col(c).alias(f"a_{c}") for c in [*asked.columns, "part"]])
        return rows.groupBy("anchor_block", "part").cogroup(named.groupBy("a_anchor_block", "a_part")).applyInArrow(run, schema)

    positives = materialize(_merged(meet(queries, positives_of(n_positives)), ["key"], n_positives, parts), "hard-negative-positives")
    bounds = F.array_distinct(F.transform("best", lambda b: -b["score"]))
    known = queries.join(positives, "key").withColumn("bounds", bounds).drop("best")
    negatives = _merged(meet(known, negatives_of(n_negatives, percent)), ["key", "bound"], n_negatives, parts)
    pairs = queries.select("key", F.col("id").alias("anchor_id")).join(positives, "key").select("key", "anchor_id", F.explode("best").alias("p"))
    pairs = pairs.select("key", "anchor_id", F.col("p.id").alias("positive_id"), (-F.col("p.score")).alias("bound"))
    out = pairs.join(negatives, ["key", "bound"]).select("anchor_id", "positive_id", "bound", F.posexplode("best").alias("at", "n"))
    return out.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), F.col("bound").alias("positive_score"), (-F.col("n.score")).alias("negative_score")
    )
