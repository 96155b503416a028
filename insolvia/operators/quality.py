"""Data-quality gates and checks.

Checks return small tables of metrics.  Everything that can be counted in one pass is
counted in one ``agg``; only duplicates (a shuffle on the key) and quantile fences
(see operators/order.py) need their own jobs.
"""
from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contracts import MIN_FISCAL_YEAR, Contract, static_kind_match
from ..functions.scalars import finite_or_null, is_infinite, melt, nan_as_null, numeric_columns, rounded_even, to_number, to_time
from ..session import materialize
from .order import grouped_quantile, over_sequence, quantiles
from .skew import join_to_keys
from .wide import feature_numbers, per_feature

# Weights of the quality components and the grade cut-offs.
QUALITY_WEIGHTS = {"schema": 0.20, "completeness": 0.25, "uniqueness": 0.15, "validity": 0.25, "timeliness": 0.15}
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))

DATETIME_PARSE_SHARE = 0.9


def one_row(df: DataFrame, **values) -> DataFrame:
    """A one-row table from driver-side scalars."""
    schema = T.StructType()
    for k, v in values.items():
        kind = T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else (
            T.DoubleType() if isinstance(v, float) else T.StringType())
        schema = schema.add(k, kind)
    return df.sparkSession.createDataFrame([tuple(values.values())], schema)


def _field(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


# ---------------------------------------------------------------- missing values
def missing_counts(df: DataFrame) -> DataFrame:
    """One row per column: missing count and share (one scan, then a tiny unpivot)."""
    cols = df.columns
    row = nan_as_null(df).agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    long = row.select(
        "n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(cols)])).alias("s")
    )
    return long.select("s.column", "s.missing", rounded_even(F.col("s.missing") / F.greatest("n", F.lit(1)), 4).alias("pct"), "n")


def missing_metrics(df: DataFrame, required: Sequence[str] = (), warn: float = 0.30, error: float = 0.90) -> DataFrame:
    per = missing_counts(df)
    return per.agg(
        F.sum("missing").alias("total_missing"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
        F.count_if(F.col("column").isin(*required) & (F.col("pct") >= error)).alias("required_mostly_missing")
        if required
        else F.lit(0).cast("bigint").alias("required_mostly_missing"),
        F.count_if((F.col("pct") >= warn) & (F.col("pct") < error)).alias("heavy_columns"),
        rounded_even(F.sum("missing") / F.greatest(F.sum("n"), F.lit(1)), 4).alias("overall_missing_pct"),
        rounded_even(1 - F.sum("missing") / F.greatest(F.sum("n"), F.lit(1)), 4).alias("completeness_score"),
    )


# ---------------------------------------------------------------- duplicates
def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key.  Partial counts combine before the shuffle."""
    return df.groupBy(*keys).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    d = duplicate_count(df, df.columns)
    pct = F.col("duplicates") / F.greatest("n_rows", F.lit(1))
    return d.select(
        "n_rows",
        F.col("duplicates").alias("duplicate_rows"),
        rounded_even(pct, 4).alias("duplicate_row_pct"),
        rounded_even(1 - pct, 4).alias("uniqueness_score"),
    )


def natural_key_duplicates(df: DataFrame, contract: Contract) -> DataFrame:
    """Duplicates on (entity, dates), on the entity alone, or on each timestamp alone."""
    entity = contract.entity if contract.entity in df.columns else None
    dates = [c for c in (*contract.dates, *contract.years) if c in df.columns]
    if entity:
        keysets = [([entity, *dates], "duplicate_entity_timestamps" if dates else "duplicate_entity_records")]
    else:
        keysets = [([d], "duplicate_timestamps") for d in dates]
    out = None
    for keys, code in keysets:
        part = duplicate_count(df, keys).select(
            F.lit(code).alias("code"), F.lit(",".join(keys)).alias("key"), F.col("duplicates").alias("count")
        )
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "code string, key string, count bigint")


# ---------------------------------------------------------------- schema contract
def kind_matches(df: DataFrame, contract: Contract) -> dict[str, bool]:
    """Per known column, whether its type (or, for text dates, 90 % of its values) fits."""
    verdict, probe = {}, []
    for c, kind in contract.known.items():
        if c in df.columns:
            fit = static_kind_match(kind, _field(df, c))
            if fit is None:
                probe.append(c)
            else:
                verdict[c] = fit
    if probe:
        row = df.agg(*[F.avg(to_time(c).isNotNull().cast("double")).alias(c) for c in probe]).first()
        verdict.update({c: (row[c] or 0.0) >= DATETIME_PARSE_SHARE for c in probe})
    return verdict


def schema_metrics(df: DataFrame, contract: Contract) -> DataFrame:
    have = set(df.columns)
    missing_required = [c for c in contract.required if c not in have]
    missing_optional = [c for c in contract.optional if c not in have]
    unexpected = sorted(have - set(contract.known))
    mismatched = [c for c, ok in kind_matches(df, contract).items() if not ok]
    score = 1.0 - len(missing_required) / max(len(contract.required), 1) - 0.25 * len(mismatched) / max(len(contract.known), 1)
    return one_row(
        df,
        n_required=len(contract.required),
        missing_required=",".join(missing_required),
        missing_optional=",".join(missing_optional),
        unexpected=",".join(unexpected),
        unexpected_level="info" if contract.dynamic else "warn",
        dtype_mismatch=",".join(mismatched),
        schema_score=max(0.0, score),
    )


# ---------------------------------------------------------------- outliers
def outlier_columns(df: DataFrame, contract: Contract | None = None, min_distinct: int = 5) -> list[str]:
    """Numeric, non-key columns with at least ``min_distinct`` finite values."""
    skip = set()
    if contract:
        skip = {*contract.series_keys, *contract.years, contract.entity}
    cols = [c for c in numeric_columns(df) if c not in skip]
    if not cols:
        return []
    # a bounded set per column: distinctness is only tested up to min_distinct
    rough = feature_numbers(df, cols, {"d": lambda x: F.approx_count_distinct(finite_or_null(x))})
    keep = []
    for c in cols:
        if (rough[c]["d"] or 0) >= 4 * min_distinct:
            keep.append(c)
        elif df.select(finite_or_null(c).alias("v")).dropna().distinct().limit(min_distinct).count() >= min_distinct:
            keep.append(c)
    return keep


def finite_frame(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[finite_or_null(c).alias(c) for c in columns])


def iqr_fences(df: DataFrame, columns: Sequence[str], multiplier: float) -> dict[str, tuple[float, float, float]]:
    """(lower, upper, iqr) per column from exact quartiles."""
    out = {}
    for c, (q1, q3) in quantiles(df, columns, [0.25, 0.75]).items():
        if q1 is not None:
            out[c] = (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1), q3 - q1)
    return out


def _long_from_wide(row: DataFrame, columns: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Turn a one-row wide aggregate with columns f"{prefix}{i}" into one row per feature."""
    structs = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{p}{i}").alias(name) for name, p in fields.items()])
        for i, c in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def iqr_outliers(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5, min_rows: int = 20) -> DataFrame:
    """Share of non-null values outside the fences; columns with too few values or a zero
    range are left out."""
    df = finite_frame(df, columns)
    fences = {c: {"lo": f[0], "hi": f[1]} for c, f in iqr_fences(df, columns, multiplier).items() if f[2] > 0}
    if not fences:
        return df.sparkSession.createDataFrame([], "feature string, pct double")
    outside = lambda x, k: F.avg(((x < k["lo"]) | (x > k["hi"])).cast("double"))
    out = per_feature(df, list(fences), {"n": lambda x, k: F.count(x), "pct": outside}, constants=fences)
    return out.filter(F.col("n") >= min_rows).select("feature", rounded_even("pct", 4).alias("pct"))


def zscore_outliers(df: DataFrame, columns: Sequence[str], threshold: float = 3.0, min_rows: int = 20) -> DataFrame:
    """Share of non-null values with |z| above the threshold (population deviation)."""
    df = finite_frame(df, columns)
    stats = feature_numbers(df, columns, {"n": F.count, "m": F.avg, "s": F.stddev_pop})
    usable = {c: {"m": v["m"], "s": v["s"]} for c, v in stats.items() if (v["n"] or 0) >= min_rows and (v["s"] or 0) > 0}
    if not usable:
        return df.sparkSession.createDataFrame([], "feature string, pct double")
    far = lambda x, k: F.avg((F.abs(x - k["m"]) / k["s"] > threshold).cast("double"))
    return per_feature(df, list(usable), {"pct": far}, constants=usable).select("feature", rounded_even("pct", 4).alias("pct"))


def far_out_columns(df: DataFrame, columns: Sequence[str], max_share: float = 0.20) -> DataFrame:
    """Columns with more than ``max_share`` of values beyond 3 interquartile ranges."""
    return iqr_outliers(df, columns, 3.0).withColumn("flagged", F.col("pct") > max_share)


# ---------------------------------------------------------------- value rules
def rule_counters(df: DataFrame, contract: Contract, as_of: str, as_of_year: int, grace_days: int = 2) -> list[tuple[str, str, str, bool, Column]]:
    """(code, column, level, counts as invalid, counter) for every rule of a contract.

    All counters share one scan.  ``as_of`` is passed in so that results are repeatable.
    """
    rules = []
    have = set(df.columns)
    for c in contract.nonneg:
        if c in have:
            rules.append(("negative_value", c, "error", True, F.count_if(to_number(c) < 0)))
    for c in contract.positive:
        if c in have:
            rules.append(("nonpositive_value", c, "error", True, F.count_if(to_number(c) <= 0)))
    for c, (lo, hi) in contract.ratio_bounds.items():
        if c in have:
            x = to_number(c)
            rules.append(("impossible_ratio", c, "warn", True, F.count_if((x < lo) | (x > hi))))
    if contract.concept in have and contract.value in have:
        x = to_number(contract.value)
        for concept, rule in contract.concept_rules.items():
            bad = x <= 0 if rule == "positive" else x < 0 if rule == "nonneg" else F.lit(False)
            rules.append(("invalid_concept_value", concept, "error", True, F.count_if((F.col(contract.concept) == concept) & bad)))
    if contract.fiscal_year in have:
        y = to_number(contract.fiscal_year)
        rules.append(("invalid_fiscal_year", contract.fiscal_year, "warn", False, F.count_if((y < MIN_FISCAL_YEAR) | (y > as_of_year + 1))))
    cutoff = F.lit(as_of).cast("timestamp") + F.expr(f"INTERVAL {int(grace_days)} DAYS")
    for c in contract.dates:
        if c in have:
            rules.append(("future_date", c, "error", True, F.count_if(to_time(c, _field(df, c)) > cutoff)))
    for c in contract.years:
        if c in have:
            rules.append(("future_year", c, "warn", False, F.count_if(to_number(c) > as_of_year + 1)))
    return rules


def value_rules(df: DataFrame, contract: Contract, as_of: str, as_of_year: int, grace_days: int = 2) -> DataFrame:
    """One row per rule with its violation count."""
    rules = rule_counters(df, contract, as_of, as_of_year, grace_days)
    if not rules:
        return df.sparkSession.createDataFrame([], "code string, column string, level string, counted boolean, count bigint, n_rows bigint")
    row = df.agg(F.count("*").alias("n_rows"), *[r[4].alias(f"r{i}") for i, r in enumerate(rules)])
    structs = [
        F.struct(
            F.lit(code).alias("code"), F.lit(col).alias("column"), F.lit(level).alias("level"),
            F.lit(counted).alias("counted"), F.col(f"r{i}").alias("count"),
        )
        for i, (code, col, level, counted, _) in enumerate(rules)
    ]
    return row.select("n_rows", F.explode(F.array(*structs)).alias("s")).select("s.*", "n_rows")


def validity_metrics(rules: DataFrame) -> DataFrame:
    """Violations over rows.  One row may violate several rules and then counts several times."""
    bad = F.sum(F.when(F.col("counted"), F.col("count")).otherwise(0))
    n = F.greatest(F.max("n_rows"), F.lit(1))
    return rules.agg(
        bad.alias("invalid_rows"),
        rounded_even(bad / n, 4).alias("invalid_pct"),
        rounded_even(F.greatest(F.lit(0.0), 1 - bad / n), 4).alias("validity_score"),
    )


def concept_rule_counts(df: DataFrame, concept: str, value: str, rules: dict[str, str]) -> DataFrame:
    """Sign-rule violations per concept of a long table; the rule table is a literal."""
    rule = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])[F.col(concept)]
    x = to_number(value)
    bad = F.when(rule == "positive", x <= 0).when(rule == "nonneg", x < 0).otherwise(False)
    return (
        df.filter(F.col(concept).isin(*rules))
        .groupBy(F.col(concept).alias("concept"))
        .agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("invalid"))
    )


def range_violations(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Below / above counts with the observed extremes; either bound may be open."""
    cols = [c for c in ranges if c in df.columns]
    aggs = []
    for i, c in enumerate(cols):
        lo, hi = ranges[c]
        x = to_number(c)
        aggs += [
            (F.count_if(x < lo) if lo is not None else F.count_if(F.lit(False))).alias(f"b{i}"),
            (F.count_if(x > hi) if hi is not None else F.count_if(F.lit(False))).alias(f"a{i}"),
            F.min(x).alias(f"lo{i}"),
            F.max(x).alias(f"hi{i}"),
        ]
    return _long_from_wide(df.agg(*aggs), cols, {"below": "b", "above": "a", "observed_min": "lo", "observed_max": "hi"})


def key_health(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nulls per key column and duplicates on the whole key."""
    nulls = df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys]).first()
    return duplicate_count(df, keys).select(
        F.lit(sum(nulls[k] for k in keys)).cast("bigint").alias("null_keys"),
        F.col("duplicates").alias("duplicate_keys"),
        F.lit("FAIL" if any(nulls[k] for k in keys) else "PASS").alias("null_level"),
        F.when(F.col("duplicates") > 0, "WARN").otherwise("PASS").alias("duplicate_level"),
    )


def infinite_columns(df: DataFrame) -> DataFrame:
    cols = numeric_columns(df)
    row = df.agg(*[F.count_if(is_infinite(F.col(c).cast("double"))).alias(f"i{i}") for i, c in enumerate(cols)])
    return _long_from_wide(row, cols, {"n_infinite": "i"})


def floor_and_columns(df: DataFrame, min_rows: int, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.when(F.col("n_rows") < min_rows, "FAIL").otherwise("PASS").alias("row_count_level"),
        F.lit(",".join(missing)).alias("missing_columns"),
        F.lit("FAIL" if missing else "PASS").alias("schema_level"),
    )


def freshness(df: DataFrame, date: str, max_age_days: int, as_of: str) -> DataFrame:
    newest = F.max(to_time(date, _field(df, date)))
    age = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("newest")) / 86400)
    return df.agg(newest.alias("newest")).select(
        F.date_format("newest", "yyyy-MM-dd").alias("newest"),
        age.cast("bigint").alias("age_days"),
        F.when(F.col("newest").isNull() | (age > max_age_days), "WARN").otherwise("PASS").alias("level"),
    )


# ---------------------------------------------------------------- time series
def unparseable_times(df: DataFrame, date: str) -> DataFrame:
    t = to_time(date, _field(df, date))
    return df.agg(F.count("*").alias("n_rows"), F.count_if(t.isNull()).alias("unparseable"))


def unordered_series(df: DataFrame, entity: str, time: str, seq: str, width: int = 1_000_000) -> DataFrame:
    """Whether each series' times never decrease in ingest order.

    The integer ingest sequence is cut into stretches of ``width``; a stretch is checked
    on its own and handed on as (first, last, ok), so a series of any length stays cheap.
    """
    stretch = F.expr(f"`{seq}` div {int(width)}")
    rows = df.select(F.col(entity).alias("entity"), F.col(time).alias("t"), F.col(seq).alias("s"), stretch.alias("g")).filter(F.col("t").isNotNull())
    inner = Window.partitionBy("entity", "g").orderBy("s")
    marked = rows.withColumn("down", F.coalesce(F.col("t") < F.lag("t").over(inner), F.lit(False)))
    pieces = marked.groupBy("entity", "g").agg(
        F.bool_or("down").alias("down"), F.min_by("t", "s").alias("first"), F.max_by("t", "s").alias("last"), F.count("*").alias("n")
    )
    # A sparse sequence leaves as many stretches as rows: they take the bounded route too.
    pieces = materialize(pieces, "stretches")
    joined = over_sequence(pieces, ["entity"], ["g"], 1, lambda w: {"step_down": F.coalesce(F.col("first") < F.lag("last").over(w), F.lit(False))})
    joined = joined.withColumn("down", F.col("down") | F.col("step_down"))
    return joined.groupBy("entity").agg(F.bool_or("down").alias("unordered"), F.sum("n").alias("n"))


def duplicate_times(df: DataFrame, entity: str, time: str) -> DataFrame:
    return (
        df.filter(F.col(time).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(time).alias("t"))
        .count()
        .groupBy("entity")
        .agg(F.sum(F.col("count") - 1).alias("duplicate_timestamps"))
    )


def series_gaps(df: DataFrame, entity: str, time: str, factor: float = 3.0) -> DataFrame:
    """Steps longer than ``factor`` times the series' median step, on distinct sorted times.

    Equal steps are counted first and the median is read off running totals, so a series
    of any length is handled without gathering it.
    """
    times = df.select(F.col(entity).alias("entity"), F.col(time).alias("t")).dropna().distinct()
    kind = _field(df, time)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.unix_micros(F.col("t").cast("timestamp")) / F.lit(1e6)
    elif isinstance(kind, T.DateType):
        seconds = F.datediff("t", F.lit("1970-01-01")) * F.lit(86400.0)
    else:
        seconds = F.col("t").cast("double")
    times = times.select("entity", seconds.alias("t"))
    steps = over_sequence(times, ["entity"], ["t"], 1, lambda w: {"step": F.col("t") - F.lag("t").over(w)})
    counted = materialize(
        steps.filter(F.col("step").isNotNull()).groupBy("entity", F.round("step", 6).alias("step")).agg(F.count("*").alias("n")),
        "steps",
    )
    median = grouped_quantile(counted, ["entity"], "step", "n", 0.5).select("entity", "total", "n_values", F.col("quantile").alias("median"))
    return (
        join_to_keys(counted, median, ["entity"], "n_values")
        .filter((F.col("median") > 0) & (F.col("total") >= 2))
        .groupBy("entity")
        .agg(
            F.max("median").alias("median_step"),
            F.sum(F.when(F.col("step") > factor * F.col("median"), F.col("n")).otherwise(0)).alias("n_gaps"),
        )
    )


def timeliness(df: DataFrame, entity: str, time: str, seq: str) -> DataFrame:
    return unordered_series(df, entity, time, seq).agg(
        F.count("*").alias("n_series"),
        F.count_if("unordered").alias("unordered_series"),
        rounded_even(1 - F.count_if("unordered") / F.greatest(F.count("*"), F.lit(1)), 4).alias("timeliness_score"),
    )


# ---------------------------------------------------------------- score
def quality_score(components: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted 0-100 score and grade.  Missing component columns or nulls count as 1;
    validity is lowered by half of ``mean_iqr_pct`` when that column is present."""
    weights = {**QUALITY_WEIGHTS, **(weights or {})}
    have = set(components.columns)
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(1.0)) if c in have else F.lit(1.0) for c in weights}
    if "mean_iqr_pct" in have:
        value["validity"] = F.greatest(F.lit(0.0), value["validity"] - 0.5 * F.coalesce(F.col("mean_iqr_pct"), F.lit(0.0)))
    total = sum(weights.values()) or 1.0
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + F.lit(w) * value[c]
    score = F.least(F.greatest(score * 100.0 / total, F.lit(0.0)), F.lit(100.0))
    grade = F.lit("F")
    for cut, letter in reversed(GRADES):
        grade = F.when(F.col("score") >= cut, letter).otherwise(grade)
    return components.withColumn("score", score).withColumn("grade", grade)


# ---------------------------------------------------------------- table gates
def landing_gate(df: DataFrame, source: str, required: Sequence[str], max_missing: float = 0.5, non_empty: bool = True) -> DataFrame:
    """The check every source passes through before it is stored."""
    missing_cols = [c for c in required if c not in df.columns]
    per = missing_counts(df).agg(F.sum("missing").alias("missing"), F.max("n").alias("n_rows"), F.sum("n").alias("cells")).first()
    n, cells, missing = per["n_rows"] or 0, per["cells"] or 0, per["missing"] or 0
    dup = duplicate_count(df, df.columns).first()["duplicates"] if n else 0
    share = missing / max(cells, 1)
    empty = non_empty and n == 0
    errors = 1 if empty else (1 if missing_cols else 0) + (1 if share > max_missing else 0)
    warnings = 0 if empty else (1 if 0 < share <= max_missing else 0) + (1 if dup else 0)
    return one_row(
        df, source=source, n_rows=n, n_cols=len(df.columns), missing_columns=",".join(missing_cols),
        missing_total_pct=float(share), duplicate_rows=dup, schema_ok=not (empty or missing_cols),
        n_errors=errors, n_warnings=warnings, is_valid=errors == 0,
    )


def modelling_gate(df: DataFrame, target: str, min_rows: int = 100, max_missing: float = 0.5, min_minority: float = 0.01) -> DataFrame:
    """Findings that decide whether a table can be modelled: one row per finding."""
    findings: list[tuple[str, str, str, float]] = []
    features = [c for c in df.columns if c != target]
    numeric = [c for c in numeric_columns(df) if c != target]
    if target not in df.columns:
        n = df.count()
        if n < min_rows:
            findings.append(("error", "empty" if n == 0 else "too_few_rows", "", float(n)))
        if n:
            findings.append(("error", "target_missing", target, 1.0))
        return df.sparkSession.createDataFrame(findings, "level string, code string, column string, value double")
    aggs = [F.count("*").alias("n")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    aggs += [F.min(c).alias(f"lo{i}") for i, c in enumerate(numeric)]
    aggs += [F.max(c).alias(f"hi{i}") for i, c in enumerate(numeric)]
    aggs += [F.count_if(is_infinite(F.col(c).cast("double"))).alias(f"inf{i}") for i, c in enumerate(numeric)]
    row = df.agg(*aggs).first()
    n = row["n"]
    missing = {c: row[f"m{i}"] for i, c in enumerate(df.columns)}
    if n < min_rows:
        findings.append(("error", "empty" if n == 0 else "too_few_rows", "", float(n)))
    if missing[target]:
        findings.append(("error", "target_nulls", target, float(missing[target])))
    classes = df.filter(F.col(target).isNotNull()).groupBy(target).count()
    summary = classes.agg(
        F.count("*").alias("k"), F.sum("count").alias("n"),
        F.sum(F.when(F.col(target) == 1, F.col("count")).otherwise(0)).alias("pos"),
        F.bool_and(F.col(target).isin(0, 1)).alias("binary"),
    ).first()
    if summary["k"] < 2:
        findings.append(("error", "single_class", target, float(summary["k"])))
    elif summary["k"] > 2 or not summary["binary"]:
        findings.append(("warn", "target_not_binary", target, float(summary["k"])))
    if summary["k"] == 2:
        pos = summary["pos"]
        share = min(pos, summary["n"] - pos) / max(summary["n"], 1)
        if share < min_minority:
            findings.append(("warn", "class_imbalance", target, float(share)))
    sparse = [c for c in df.columns if n and missing[c] / n > max_missing]
    for c in sparse:
        findings.append(("error", "sparse_column", c, missing[c] / n))
    if not sparse and any(missing.values()):
        findings.append(("warn", "some_missing", "", sum(missing.values()) / max(n * len(df.columns), 1)))
    for c in features:
        if c not in numeric:
            findings.append(("warn", "non_numeric", c, 1.0))
    for i, c in enumerate(numeric):
        if row[f"lo{i}"] == row[f"hi{i}"]:
            findings.append(("warn", "constant_column", c, 1.0))
        if row[f"inf{i}"]:
            findings.append(("error", "infinite_values", c, float(row[f"inf{i}"])))
    dup = duplicate_count(df, df.columns).first()["duplicates"]
    if dup:
        findings.append(("warn", "duplicate_rows", "", float(dup)))
    return df.sparkSession.createDataFrame(findings, "level string, code string, column string, value double")


def corpus_coverage(expected: DataFrame, present: DataFrame, manifest: DataFrame) -> DataFrame:
    """Expected sources against stored data (source, n_rows) and run status (source, status)."""
    e = expected.select("source").distinct().withColumn("known", F.lit(True))
    joined = e.join(present.select("source", "n_rows"), "source", "full").join(manifest.select("source", "status"), "source", "full")
    return joined.select(
        "source",
        F.col("n_rows").isNotNull().alias("present"),
        F.when(F.col("n_rows").isNotNull(), "PASS").when(F.col("status") == "success", "FAIL").otherwise("WARN").alias("level"),
        F.when(F.col("n_rows").isNotNull(), "stored")
        .when(F.col("status") == "success", "reported success but nothing stored")
        .when(F.col("status").isin("failed", "skipped"), F.concat(F.lit("last run: "), F.col("status")))
        .otherwise("never run")
        .alias("reason"),
    )


def ready_to_train(df: DataFrame, target: str, split: str = "split", required: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Per split: rows, labels outside 0/1, null, NaN and infinite cells, and a verdict."""
    cols = [c for c in df.columns if c != split]
    numeric = [c for c in numeric_columns(df) if c in cols]
    bad_cell = F.lit(0)
    for c in cols:
        cell = F.col(c).isNull()
        if c in numeric:
            x = F.col(c).cast("double")
            cell = cell | F.isnan(x) | is_infinite(x)
        bad_cell = bad_cell + F.when(cell, 1).otherwise(0)
    out = df.groupBy(F.col(split).alias("split")).agg(
        F.count("*").alias("n_rows"),
        F.count_if(~F.col(target).isin(0, 1)).alias("bad_labels"),
        F.sum(bad_cell).alias("bad_cells"),
    )
    names = df.sparkSession.createDataFrame([(s,) for s in required], "split string")
    return names.join(out, "split", "left").select(
        "split",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("bad_labels", F.lit(0)).alias("bad_labels"),
        F.coalesce("bad_cells", F.lit(0)).alias("bad_cells"),
        F.when((F.col("n_rows") > 0) & (F.col("bad_labels") == 0) & (F.col("bad_cells") == 0), True).otherwise(False).alias("ready"),
    )


def payload_issues(df: DataFrame, expected: Sequence[str], features: str = "features", id_col: str = "id") -> DataFrame:
    """One row per (payload, feature) problem of a map<string,string> payload column."""
    names = F.array(*[F.lit(x) for x in expected])
    m = F.col(features)

    def issue(name, severity, text):
        return F.struct(name.alias("feature"), F.lit(severity).alias("severity"), F.lit(text).alias("issue"))

    number = lambda v: v.try_cast("double")
    bad_type = F.filter(F.map_entries(m), lambda e: F.array_contains(names, e["key"]) & e["value"].isNotNull() & number(e["value"]).isNull())
    not_finite = F.filter(
        F.map_entries(m),
        lambda e: F.array_contains(names, e["key"])
        & (e["value"].isNull() | F.isnan(number(e["value"])) | (F.abs(number(e["value"])) == float("inf"))),
    )
    issues = F.concat(
        F.transform(F.array_except(names, F.map_keys(m)), lambda n: issue(n, "error", "no value for this feature")),
        F.transform(F.array_except(F.map_keys(m), names), lambda n: issue(n, "warning", "not a feature of the model, left aside")),
        F.transform(not_finite, lambda e: issue(e["key"], "error", "not a finite number")),
        F.transform(bad_type, lambda e: issue(e["key"], "error", "text where a number belongs")),
    )
    empty = F.array(issue(F.lit(""), "error", "payload without any feature"))
    all_issues = F.when(m.isNull() | (F.size(m) == 0), empty).otherwise(issues)
    return df.select(F.col(id_col).alias("id"), F.explode(all_issues).alias("i")).select("id", "i.*")


def findings_json(findings: DataFrame) -> list[dict]:
    from ..session import bounded_collect

    return [json.loads(r) for r in (x[0] for x in bounded_collect(findings.select(F.to_json(F.struct("*")))))]
