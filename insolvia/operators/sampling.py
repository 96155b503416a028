"""Sorting, top-k, splits, folds, duplicate removal and set operations."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .order import bucket_by_cuts, cut_at, cuts_by_group, hash_uniform


def sort_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def top_n(df: DataFrame, by: str, n: int, tie_break: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *tie_break).limit(n)


def _quota(n: Column, share: float) -> Column:
    """Rows that make up ``share`` of ``n``, rounded half up."""
    return F.floor(n * share + 0.5)


def _by_class(df: DataFrame, label: str, order: Sequence[str], sizes: Sequence, column: str, names: Sequence):
    """Cut every class separately behind its first ``size(n)`` rows and name the pieces.

    The boundary search reads a stored copy of the label and order columns only; its number
    of jobs does not grow with the classes.  The rows get their piece by a join with one row a class.
    """
    narrow = materialize(df.select(label, *order), "ranks")
    cuts = materialize(cuts_by_group(narrow, label, order, sizes), "cuts")
    here = F.struct(*order)
    piece = F.lit(names[-1])
    for i in range(len(sizes) - 1, -1, -1):
        piece = F.when(here <= F.col(f"_cut{i}"), F.lit(names[i])).otherwise(piece)
    return df.join(cuts, df[label].eqNullSafe(cuts["_group"]), "left").select(*[df[c] for c in df.columns], piece.alias(column))


def stratified_split(
    df: DataFrame, label: str, key: str, test: float = 0.15, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """Random train/val/test column with the class mix kept.  Rows are ranked by key hash
    inside each class; only the two boundary ranks are searched, nothing is sorted."""
    hashed = df.withColumn("_h", hash_uniform(key, seed=seed))
    out = _by_class(
        hashed,
        label,
        ["_h", key],
        [lambda n: _quota(n, test), lambda n: _quota(n, test) + _quota(n, val)],
        "split",
        ["test", "val", "train"],
    )
    return out.drop("_h")


def time_split(df: DataFrame, order: Sequence[str], test: float = 0.15, val: float = 0.15) -> DataFrame:
    """Oldest rows train, newest test.  ``val`` is a share of what test leaves over."""
    n = df.count()
    test_start = int(n * (1 - test))
    val_start = int(test_start * (1 - val))
    cuts = cut_at(df, order, [val_start, test_start])
    names = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    return df.withColumn("split", F.element_at(names, bucket_by_cuts(cuts) + 1))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold 0..k-1 per row, each class spread evenly over the folds."""
    hashed = df.withColumn("_h", hash_uniform(key, seed=seed))
    sizes = [lambda n, i=i: F.floor(n * (i + 1) / k) for i in range(k - 1)]
    return _by_class(hashed, label, ["_h", key], sizes, "fold", list(range(k))).drop("_h")


def expanding_time_folds(df: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    """Block 0 only trains; block i (1..k) is the test part of fold i, trained on all earlier blocks."""
    n = df.count()
    size = n // (k + 1)
    cuts = cut_at(df, order, [n - (k - i) * size for i in range(k)])
    return df.withColumn("block", bucket_by_cuts(cuts))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def keep_one(df: DataFrame, keys: Sequence[str], seq: str, keep: str = "last") -> DataFrame:
    """One row per key: the first or last in ingest order.  A max/min_by aggregate combines
    map-side, so a key that repeats a billion times costs one row per task."""
    pick = F.max_by if keep == "last" else F.min_by
    others = [c for c in df.columns if c not in keys]
    if others == [seq]:  # nothing else to carry along: a plain hash aggregate will do
        return df.groupBy(*keys).agg((F.max if keep == "last" else F.min)(seq).alias(seq)).select(*df.columns)
    packed = df.groupBy(*keys).agg(pick(F.struct(*others), F.col(seq)).alias("_r"))
    return packed.select(*keys, "_r.*").select(*df.columns)


def drop_duplicates_by_contract(
    df: DataFrame,
    seq: str,
    entity: str | None = None,
    dates: Sequence[str] = (),
    keep: str = "last",
    drop_rows: bool = True,
    drop_entity_timestamps: bool = True,
    drop_timestamps: bool = True,
) -> DataFrame:
    """Full-row duplicates (ignoring the ingest sequence), then the natural key."""
    if drop_rows:
        df = keep_one(df, [c for c in df.columns if c != seq], seq, keep)
    if entity and dates and drop_entity_timestamps:
        df = keep_one(df, [entity, *dates], seq, keep)
    elif dates and not entity and drop_timestamps:
        for d in dates:
            df = keep_one(df, [d], seq, keep)
    return df


def union_all(frames: Sequence[DataFrame], allow_missing: bool = True) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out


def shared_entities(universes: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Size of each source's entity set and of their intersection, from one aggregate.

    Each (entity, source) pair is reduced before the entity shuffle; no set is collected.
    """
    parts = [
        df.select(F.col(c).cast("string").alias("e"), F.lit(name).alias("source")).dropna().distinct()
        for name, (df, c) in universes.items()
    ]
    pairs = union_all(parts)
    spread = pairs.groupBy("e").agg(F.count("*").alias("n"))
    common = spread.agg(F.count_if(F.col("n") == len(universes))).first()[0]
    sizes = pairs.groupBy("source").agg(F.count("*").alias("n_entities"))
    return sizes.withColumn("n_common", F.lit(common).cast("bigint"))
