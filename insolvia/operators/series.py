"""Per-entity ordered series: returns, rolling statistics, entity aggregates, panels."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import over_sequence, running_totals
from .sampling import union_all
from .skew import join_to_keys

# Rolling window of the volatility and trading periods per year.
VOLATILITY_ROWS, PERIODS_PER_YEAR = 21, 252


def period_returns(df: DataFrame, entity: str, date: str, close: str, out: str = "daily_return") -> DataFrame:
    """Relative change of the last known close.  A missing close repeats the previous one,
    so its return is 0 once the series has started and null before."""
    known = over_sequence(
        df.filter(F.col(close).isNotNull()), [entity], [date], 1,
        lambda w: {out: F.try_divide(F.col(close), F.lag(close).over(w)) - 1},
    )
    gaps = df.filter(F.col(close).isNull())
    start = df.groupBy(entity).agg(F.min(F.when(F.col(close).isNotNull(), F.col(date))).alias("_start"), F.count("*").alias("_n"))
    filled = join_to_keys(gaps, start, [entity], "_n").withColumn(out, F.when(F.col(date) > F.col("_start"), F.lit(0.0))).drop("_start")
    return known.unionByName(filled)


def rolling_volatility(
    df: DataFrame, entity: str, date: str, returns: str, rows: int = VOLATILITY_ROWS, periods: int = PERIODS_PER_YEAR, out: str = "volatility"
) -> DataFrame:
    """Annualised sample deviation of the last ``rows`` returns; null until all are present."""

    def build(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        return {out: F.when(F.count(returns).over(frame) == rows, F.stddev_samp(returns).over(frame) * math.sqrt(periods))}

    return over_sequence(df, [entity], [date], rows - 1, build)


def rolling_statistics(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], window: int = 3) -> DataFrame:
    """roll<w>_mean__c and roll<w>_std__c over the last ``window`` rows, from the first row on."""

    def build(w):
        frame = w.rowsBetween(-(window - 1), 0)
        return {
            f"roll{window}_{stat}__{c}": f(c).over(frame)
            for c in columns
            for stat, f in (("mean", F.avg), ("std", F.stddev_samp))
        }

    return over_sequence(df, [entity], list(order), window - 1, build)


def entity_aggregates(df: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """ent_mean__c and ent_std__c on every row.  Aggregate then join: a hot entity is
    combined map-side and its rows need not meet in one window."""
    stats = df.groupBy(entity).agg(
        F.count("*").alias("_n"), *[f(c).alias(f"ent_{stat}__{c}") for c in columns for stat, f in (("mean", F.avg), ("std", F.stddev_samp))]
    )
    return join_to_keys(df, stats, [entity], "_n")


def cumulative_gain(df: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """Share of positives captured after each row in descending score order."""
    base = df.select(key, score, label, (-F.col(score)).alias("_s"), F.lit(1).alias("_one"))
    totals = df.agg(F.count("*").alias("n"), F.sum(label).alias("p")).first()
    swept = running_totals(base, [], ["_s", key], {"position": "_one", "captured": label})
    return swept.select(
        key, "position", (F.col("position") / F.lit(float(max(totals["n"], 1)))).alias("fraction"),
        (F.col("captured") / F.lit(float(totals["p"] or 1))).alias("gain"),
    )


def outer_join_panel(parts: Sequence[tuple[str, DataFrame]], keys: Sequence[str], start=None, start_key: str | None = None) -> DataFrame:
    """Full outer join of single-series tables on ``keys``: one column per series.

    Written as union + one aggregate, so any number of series costs one shuffle, and the
    lower bound on the key is applied before it.  Each part has the keys and ``value``,
    at most one row per key.
    """
    pieces = []
    for label, df in parts:
        if start is not None:
            df = df.filter(F.col(start_key or keys[0]) >= F.lit(start))
        pieces.append(df.select(*keys, F.lit(label).alias("_s"), F.col("value").cast("double").alias("_v")))
    return union_all(pieces).groupBy(*keys).agg(*[F.max(F.when(F.col("_s") == label, F.col("_v"))).alias(label) for label, _ in parts])


def lookup_join(df: DataFrame, lookup: DataFrame, keys: Sequence[str], max_rows: int = 100_000) -> DataFrame:
    """Join coded keys to their labels; the lookup side is broadcast only when counted small."""
    small = lookup.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(lookup) if small else lookup, list(keys), "left")
