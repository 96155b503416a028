"""Joins of a large table to one row per key, when single keys may be huge."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import max_driver_rows, max_task_rows


def join_to_keys(big: DataFrame, small: DataFrame, keys: Sequence[str], weight: str, how: str = "inner") -> DataFrame:
    """Join ``big`` to ``small`` (one row per key), where ``weight`` counts the key's rows.

    Keys heavier than a task are few by definition.  They are broadcast and matched where
    the rows are, so no task receives a hot key whole; the other keys join by shuffle.
    ``weight`` is dropped from the result.
    """
    spark, keys = big.sparkSession, list(keys)
    limit = max_task_rows(spark)
    hot = small.filter(F.col(weight) > limit)
    n_hot = hot.limit(max_driver_rows(spark) + 1).count()
    rest = small.drop(weight)
    if n_hot == 0 or n_hot > max_driver_rows(spark):
        return big.join(rest, keys, how)  # adaptive execution splits what skew is left
    hot = F.broadcast(hot.drop(weight))
    cold = small.filter(F.col(weight) <= limit).drop(weight)
    on_hot = big.join(hot, keys)
    on_cold = big.join(F.broadcast(small.filter(F.col(weight) > limit).select(*keys)), keys, "left_anti").join(cold, keys, how)
    return on_hot.unionByName(on_cold)
