"""Per-column aggregates of wide tables."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import melt, number_or_null

# Beyond this many expressions one aggregate no longer compiles to a single fast loop, and
# the cells are unpivoted and grouped by column name instead.
WIDE_EXPRESSIONS = 60


def per_feature(
    df: DataFrame,
    columns: Sequence[str],
    aggs: dict[str, Callable[..., Column]],
    by: Sequence[str] = (),
    constants: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """(by…, feature, name…): each aggregate over each column, in one scan.

    An aggregate takes the column as doubles and, when ``constants`` gives each column its
    own numbers, a dict of them.  Few expressions run as one wide aggregate; many run on
    the unpivoted cells, where partial aggregation keeps one row per column and task.
    """
    columns, by = list(columns), list(by)

    def call(fn, x, consts):
        return fn(x, consts) if constants is not None else fn(x)

    if len(columns) * len(aggs) <= WIDE_EXPRESSIONS:
        literal = {c: {k: F.lit(v) for k, v in (constants or {}).get(c, {}).items()} for c in columns}
        row = df.groupBy(*by).agg(
            *[call(fn, number_or_null(c), literal[c]).alias(f"_{i}_{name}") for i, c in enumerate(columns) for name, fn in aggs.items()]
        )
        structs = [F.struct(F.lit(c).alias("feature"), *[F.col(f"_{i}_{name}").alias(name) for name in aggs]) for i, c in enumerate(columns)]
        return row.select(*by, F.explode(F.array(*structs)).alias("_s")).select(*by, "_s.*")
    extra = [by_col for by_col in by if by_col not in columns]
    long = melt(df, columns, keep=extra)
    consts = {}
    if constants is not None:
        names = list(next(iter(constants.values())))
        table = df.sparkSession.createDataFrame(
            [(c, *[constants[c][k] for k in names]) for c in columns], "feature string, " + ", ".join(f"_k_{k} double" for k in names)
        )
        long = long.join(F.broadcast(table), "feature")  # one row per column
        consts = {k: F.col(f"_k_{k}") for k in names}
    return long.groupBy(*by, "feature").agg(*[call(fn, F.col("value"), consts).alias(name) for name, fn in aggs.items()])


def feature_numbers(df: DataFrame, columns: Sequence[str], aggs: dict[str, Callable[[Column], Column]]) -> dict[str, dict]:
    """The same as plain numbers on the driver: one small row per column."""
    found = {r["feature"]: r.asDict() for r in per_feature(df, columns, aggs).collect()}
    empty = dict.fromkeys(aggs)
    return {c: found.get(c, {"feature": c, **empty}) for c in columns}


def array_width(df: DataFrame, column: str) -> int:
    """The one length of an array column; arrays of different lengths are refused."""
    row = df.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).first()
    if row["low"] != row["high"]:
        raise ValueError(f"arrays of {column} have {row['low']} to {row['high']} elements")
    return row["low"] or 0
