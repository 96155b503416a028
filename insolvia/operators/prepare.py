"""Learned preparation: every step is fit on train and applied to any split.

``fit_*`` returns a small dict that survives JSON; ``apply_*`` is a pure projection or
filter, so applying a fitted chain adds no shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import NULL_TOKENS, clean_text, clipped, finite_or_null, is_infinite, numeric_columns, present, text_columns, to_time
from ..session import materialize, new_path
from .order import quantiles, with_position
from .skew import join_to_keys
from .wide import feature_numbers

# Up to so many values a column's vocabulary is part of the projection, one column per value when one-hot
# encoded; longer ones are dictionaries, tables that are joined, and give one sparse vector column.
INLINE_VALUES = 50


# ---------------------------------------------------------------- cleaning
def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def drop_infinite_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    bad = F.lit(False)
    for c in columns or numeric_columns(df):
        bad = bad | F.coalesce(is_infinite(F.col(c).cast("double")), F.lit(False))
    return df.filter(~bad)


def clean_table(
    df: DataFrame, target: str | None = None, dates: Sequence[str] = (), lower: bool = False,
    tokens: Sequence[str] = NULL_TOKENS, drop_infinite: bool = True,
) -> DataFrame:
    """Drop rows without a label, normalise text and dates, drop rows holding infinities."""
    if target:
        df = drop_missing_target(df, target)
    df = df.withColumns({c: clean_text(c, tokens, lower) for c in text_columns(df, skip=[*dates, target or ""])})
    df = df.withColumns({c: to_time(c, df.schema[c].dataType) for c in dates})
    return drop_infinite_rows(df, [c for c in numeric_columns(df) if c != target]) if drop_infinite else df


def consistency_audit(df: DataFrame, target: str) -> DataFrame:
    """Columns that are entirely null and the number of target classes."""
    cols = [c for c in df.columns if c != target]
    row = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    classes = df.filter(F.col(target).isNotNull()).select(target).distinct().count()
    rows = [(c, "entirely null") for i, c in enumerate(cols) if row["n"] and not row[f"c{i}"]]
    if classes < 2:
        rows.append((target, "fewer than 2 classes"))
    return df.sparkSession.createDataFrame(rows, "column string, finding string")


# ---------------------------------------------------------------- imputation
def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Mode per column, ties to the smallest value."""
    out: dict[str, str | None] = dict.fromkeys(columns)
    if not columns:
        return out
    long = df.select(*[present(df, c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("column").agg(F.max("n").alias("n"))
    smallest = counts.join(F.broadcast(best), ["column", "n"]).groupBy("column").agg(F.min("value").alias("value"))
    out.update({r["column"]: r["value"] for r in smallest.collect()})  # one row per column
    return out


def fit_impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), strategy: str = "median") -> dict:
    if strategy == "median":
        num = {c: q[0] for c, q in quantiles(df, numeric, [0.5]).items()}
    elif strategy == "mean":
        row = df.agg(*[F.avg(present(df, c)).alias(c) for c in numeric]).first() if numeric else {}
        num = {c: row[c] for c in numeric}
    else:
        raise ValueError(f"unknown imputation strategy {strategy}")
    return {"strategy": strategy, "numeric": num, "categorical": most_frequent(df, categorical)}


def apply_impute(df: DataFrame, fitted: dict) -> DataFrame:
    """Fill nulls, and NaN in floating columns, which the fits count as missing too."""
    fills = {**fitted["numeric"], **fitted["categorical"]}
    return df.withColumns({c: F.coalesce(present(df, c), F.lit(v)) for c, v in fills.items() if v is not None and c in df.columns})


# ---------------------------------------------------------------- outliers
def fit_clip(df: DataFrame, columns: Sequence[str], method: str = "winsorize", limits=(0.01, 0.99), multiplier: float = 1.5, z: float = 5.0) -> dict:
    """Per-column bounds.  z-score bounds are taken before any clipping, so held-out splits
    are clipped exactly as train is."""
    cols = list(columns)
    if method == "winsorize":
        bounds = {c: tuple(q) for c, q in quantiles(df, cols, limits).items()}
    elif method == "iqr_clip":
        bounds = {c: (None, None) if a is None else (a - multiplier * (b - a), b + multiplier * (b - a)) for c, (a, b) in quantiles(df, cols, [0.25, 0.75]).items()}
    elif method == "zscore_clip":
        bounds = {}
        for c, v in feature_numbers(df, cols, {"m": F.avg, "s": F.stddev_samp}).items():
            m, s = v["m"], v["s"] or 1.0
            bounds[c] = (None, None) if m is None else (m - z * s, m + z * s)
    else:
        raise ValueError(f"unknown clip method {method}")
    return {"method": method, "bounds": bounds}


def apply_clip(df: DataFrame, fitted: dict) -> DataFrame:
    """Values within the fitted bounds; NaN, which has no place among them, becomes null."""
    return df.withColumns({c: clipped(present(df, c), lo, hi) for c, (lo, hi) in fitted["bounds"].items() if c in df.columns})


def fit_zscore_filter(df: DataFrame, columns: Sequence[str], threshold: float = 5.0) -> dict:
    cols = list(columns)
    found = feature_numbers(df, cols, {"m": lambda x: F.avg(finite_or_null(x)), "s": lambda x: F.stddev_pop(finite_or_null(x))})
    return {"threshold": threshold, "stats": {c: (v["m"], v["s"]) for c, v in found.items()}}


def apply_zscore_filter(df: DataFrame, fitted: dict, train: str | None = "train", split: str = "split") -> DataFrame:
    """Drop rows with any |z| above the threshold, from train only."""
    out = F.lit(False)
    for c, (m, s) in fitted["stats"].items():
        if s:
            out = out | F.coalesce(F.abs(finite_or_null(c) - F.lit(m)) / F.lit(s) > fitted["threshold"], F.lit(False))
    if train is not None:
        out = out & (F.col(split) == train)
    return df.filter(~out)


# ---------------------------------------------------------------- encoding
def fit_categories(df: DataFrame, columns: Sequence[str], inline: int = INLINE_VALUES) -> dict:
    """Vocabulary of each column in sorted order, of any length.

    ``categories`` holds the short ones.  ``dictionaries`` names the stored table of each longer one: value,
    code (its position, counted over range partitions) and its number of rows.  At most ``inline + 1`` values of
    a column reach the driver.
    """
    vocabulary, dictionaries = {}, {}
    for c in columns:
        counted = df.select(F.col(f"`{c}`").cast("string").alias("value")).dropna().groupBy("value").agg(F.count("*").alias("n_rows"))
        counted = materialize(counted, "vocabulary")
        some = counted.limit(inline + 1).collect()
        if len(some) <= inline:
            vocabulary[c] = sorted(r["value"] for r in some)
            continue
        path = new_path(df.sparkSession, "dictionary")
        with_position(counted, ["value"], "code").write.parquet(path)
        dictionaries[c] = {"path": path, "size": counted.count()}
    return {"categories": vocabulary, "dictionaries": dictionaries}


def _coded(df: DataFrame, column: str, dictionary: dict, code: str) -> DataFrame:
    """The rows with the dictionary's code of the column as ``code``, null where it has none.  Values that fill more
    than a task are matched by a broadcast of theirs; rows without a value do not take part in the join."""
    table = df.sparkSession.read.parquet(dictionary["path"])
    key, weight = f"{code}_value", f"{code}_rows"
    known = table.select(F.col("value").alias(key), (F.col("code") - F.lit(dictionary["first"])).cast("long").alias(code), F.col("n_rows").alias(weight))
    keyed = df.withColumn(key, F.col(f"`{column}`").cast("string"))
    found = join_to_keys(keyed.filter(F.col(key).isNotNull()), known, [key], weight, "left")
    empty = keyed.filter(F.col(key).isNull()).withColumn(code, F.lit(None).cast("long"))
    return found.unionByName(empty).drop(key)


def _dictionaries(df: DataFrame, fitted: dict) -> dict[str, dict]:
    """Those of the columns at hand, with the position at which their codes begin."""
    out = {}
    for c, d in fitted.get("dictionaries", {}).items():
        if c in df.columns:
            first = df.sparkSession.read.parquet(d["path"]).agg(F.min("code")).first()[0]
            out[c] = {**d, "first": first}
    return out


def apply_onehot(df: DataFrame, fitted: dict, drop_first: bool = False) -> DataFrame:
    """0/1 columns named ``column=value``; null and unseen values are all zero.  A column with a dictionary becomes one
    sparse vector column ``column=`` with a place per value."""
    new, short = {}, [c for c in fitted["categories"] if c in df.columns]
    for c in short:
        values = fitted["categories"][c]
        for v in values[1:] if drop_first else values:
            new[f"{c}={v}"] = F.coalesce((F.col(f"`{c}`").cast("string") == F.lit(v)).cast("int"), F.lit(0))
    out = df.withColumns(new).drop(*short)
    for i, (c, d) in enumerate(_dictionaries(out, fitted).items()):
        size, skip = d["size"] - int(drop_first), int(drop_first)
        place = f"_place_{i}"
        coded = _coded(out, c, d, f"_code_{i}").withColumn(place, F.col(f"_code_{i}") - skip)
        # an encoder of `size` places; what is outside of them is the extra place, which is left out of the vector
        placed = coded.withColumn(place, F.when(F.col(place).between(0, size - 1), F.col(place)).otherwise(F.lit(size)).cast("double"))
        encoder = OneHotEncoder(inputCols=[place], outputCols=[f"{c}="], handleInvalid="keep", dropLast=True)
        model = encoder.fit(df.sparkSession.createDataFrame([(float(size - 1),)], f"{place} double"))
        out = model.transform(placed).drop(place, f"_code_{i}", c)
    return out


def apply_ordinal(df: DataFrame, fitted: dict, unknown: float = -1.0) -> DataFrame:
    """Position in the vocabulary; null and unseen values get the sentinel."""
    new = {}
    for c, values in fitted["categories"].items():
        code = F.lit(float(unknown))
        for i, v in enumerate(values):
            code = F.when(F.col(c).cast("string") == F.lit(v), F.lit(float(i))).otherwise(code)
        new[c] = code
    out = df.withColumns(new)
    for i, (c, d) in enumerate(_dictionaries(out, fitted).items()):
        columns = out.columns
        coded = _coded(out, c, d, f"_code_{i}")
        out = coded.withColumn(c, F.coalesce(F.col(f"_code_{i}").cast("double"), F.lit(float(unknown)))).select(*[f"`{x}`" for x in columns])
    return out


# ---------------------------------------------------------------- scaling
def fit_scale(df: DataFrame, columns: Sequence[str], method: str = "standard", feature_range=(0.0, 1.0)) -> dict:
    """Affine (shift, scale, offset) per column: x -> (x - shift) / scale + offset."""
    cols = list(columns)
    if method == "robust":
        stats = {c: (q[1], (q[2] - q[0]) or 1.0, 0.0) for c, q in quantiles(df, cols, [0.25, 0.5, 0.75]).items() if q[1] is not None}
        return {"method": method, "stats": stats}
    a, b = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
    stats = {}
    for c, v in feature_numbers(df, cols, {"a": a, "b": b}).items():
        x, y = v["a"], v["b"]
        if x is None:
            continue
        if method == "standard":
            stats[c] = (float(x), float(y) or 1.0, 0.0)
        elif method == "minmax":
            lo, hi = feature_range
            stats[c] = (float(x), ((float(y) - float(x)) or 1.0) / (hi - lo), float(lo))
        else:
            raise ValueError(f"unknown scaling method {method}")
    return {"method": method, "stats": stats}


def apply_scale(df: DataFrame, fitted: dict) -> DataFrame:
    absent = [c for c in fitted["stats"] if c not in df.columns]
    if absent:
        raise ValueError(f"columns missing at apply time: {absent}")
    return df.withColumns({c: (present(df, c) - F.lit(m)) / F.lit(s) + F.lit(o) for c, (m, s, o) in fitted["stats"].items()})


# ---------------------------------------------------------------- alignment
def align_columns(df: DataFrame, reference: Sequence[str]) -> DataFrame:
    """Exactly the reference columns in their order; absent ones become 0."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(0).alias(c) for c in reference])


def enforce_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"missing model features: {absent}")
    return df.select(*keep, *[F.col(f"`{c}`") for c in features])


# ---------------------------------------------------------------- simple path
def clean_simple(df: DataFrame, target: str) -> DataFrame:
    """Drop repeated rows, then fill numeric gaps with the median of what is left.
    Columns without gaps are untouched and keep their type."""
    df = df.dropDuplicates()
    columns = [c for c in numeric_columns(df) if c != target]
    gaps = df.agg(*[F.count_if(present(df, c).isNull()).alias(c) for c in columns]).first() if columns else {}
    return apply_impute(df, fit_impute(df, [c for c in columns if gaps[c]]))


def fit_simple_features(train: DataFrame, columns: Sequence[str], variance_threshold: float = 0.0) -> dict:
    """Columns whose population variance exceeds the threshold, with their scaling."""
    row = train.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    kept = [c for c in columns if row[c] is not None and row[c] > variance_threshold]
    return {"columns": kept, "scale": fit_scale(train, kept)}
