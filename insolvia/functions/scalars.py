"""Column expressions shared by the operators; all of them stay inside Spark's code generation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text tokens that mean "missing" after trimming and lower-casing.
NULL_TOKENS = ("", "na", "n/a", "none", "null", "?", "nan", "-")

# First matching keyword group names the financial category of a column.
CATEGORY_KEYWORDS = {
    "profitability": ("roa", "roe", "profit", "margin", "return", "income", "earning", "eps", "per share"),
    "liquidity": ("current ratio", "quick ratio", "cash", "liquid", "working capital", "acid"),
    "leverage": ("debt", "liability", "liabilities", "equity", "borrow", "leverage", "gearing", "solvency", "net worth"),
    "efficiency": ("turnover", "asset turnover", "frequency", "expense rate", "revenue per", "productivity", "efficiency"),
    "cash_flow": ("cash flow", "cashflow", "operating cash"),
    "growth": ("growth", "increase", "change rate"),
    "interest_rate": ("interest rate", "interest-bearing", "tax rate"),
}

# Share of the score scale where the Medium and High bands begin.
BAND_MEDIUM, BAND_HIGH = 0.33, 0.66

# Fixed value: added to ratio denominators after zeros became null.
RATIO_EPSILON = 1e-9


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Half-up rounding on the double itself, equal in every SQL engine."""
    scale = float(10**digits)
    return F.floor(as_column(c).cast("double") * scale + F.lit(0.5)).cast("double") / F.lit(scale)


def rounded_even(c: Column | str, digits: int) -> Column:
    """Array-library rounding: scale, round half to even, unscale."""
    scale = float(10**digits)
    return F.rint(as_column(c).cast("double") * scale) / F.lit(scale)


def to_number(c: Column | str) -> Column:
    """Coercing numeric cast: unreadable text and NaN become null."""
    x = as_column(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_time(c: Column | str, kind: T.DataType | None = None) -> Column:
    """Coercing timestamp parse; typed dates and timestamps pass through."""
    c = as_column(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(kind, T.DateType):
        return c.cast("timestamp")
    return F.try_to_timestamp(c.cast("string"))


def is_infinite(c: Column | str) -> Column:
    return F.abs(as_column(c)) == F.lit(float("inf"))


def finite_or_null(c: Column | str) -> Column:
    x = as_column(c).cast("double")
    return F.when(~F.isnan(x) & ~is_infinite(x), x)


def clean_text(c: Column | str, null_tokens: Sequence[str] = NULL_TOKENS, lower: bool = False) -> Column:
    text = F.trim(F.regexp_replace(as_column(c), r"\s+", " "))
    if lower:
        text = F.lower(text)
    return F.when(~F.lower(text).isin(*[t.lower() for t in null_tokens]), text)


def signed_log(c: Column | str) -> Column:
    c = as_column(c)
    return F.signum(c) * F.log1p(F.abs(c))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    b = as_column(b).cast("double")
    # a zero denominator turns null first, so the shifted one is zero only at exactly -epsilon
    out = F.try_divide(as_column(a).cast("double"), F.when(b != 0, b) + F.lit(RATIO_EPSILON))
    return F.when(~is_infinite(out), out)


def category_of(name: Column | str) -> Column:
    low = F.lower(as_column(name))
    out = F.lit("other")
    for category, words in reversed(list(CATEGORY_KEYWORDS.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(category)).otherwise(out)
    return out


def risk_score(probability: Column | str, scale: float = 100.0) -> Column:
    return rounded_even(as_column(probability) * F.lit(float(scale)), 1)


def risk_band(score: Column | str, scale: float = 100.0) -> Column:
    """Band of the already rounded score."""
    score = as_column(score)
    return (
        F.when(score < F.lit(scale * BAND_MEDIUM), F.lit("Low"))
        .when(score < F.lit(scale * BAND_HIGH), F.lit("Medium"))
        .otherwise(F.lit("High"))
    )


def confidence(probability: Column | str, threshold: Column | float) -> Column:
    """Distance from the threshold relative to the far end of the side the probability is on."""
    p = as_column(probability)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    span = F.when(p >= t, F.lit(1.0) - t).otherwise(t)
    return F.coalesce(F.least(F.try_divide(F.abs(p - t), span), F.lit(1.0)), F.lit(1.0))


def clipped(c: Column | str, lo: float | None, hi: float | None) -> Column:
    """Clip into [lo, hi]; nulls stay null (``least``/``greatest`` alone would fill them)."""
    c = as_column(c)
    if lo is None or hi is None:
        return c
    return F.when(c.isNotNull(), F.least(F.greatest(c.cast("double"), F.lit(float(lo))), F.lit(float(hi))))


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def column_kinds(df: DataFrame, target: str) -> DataFrame:
    """One row per column: role (target / numeric / categorical) decided from the schema alone."""
    rows = []
    for f in df.schema.fields:
        role = "target" if f.name == target else "numeric" if isinstance(f.dataType, T.NumericType) else "categorical"
        rows.append((f.name, role))
    return df.sparkSession.createDataFrame(rows, "feature string, role string")


def number_or_null(column: Column | str) -> Column:
    """The value as a double; NaN counts as missing, like null."""
    return F.nanvl((F.col(column) if isinstance(column, str) else column).cast("double"), F.lit(None).cast("double"))


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN of floating columns becomes null."""
    new = {c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(new) if new else df


def present(df: DataFrame, column: str) -> Column:
    """The column with NaN as null where it is a floating one; other types as they are."""
    c = F.col(f"`{column}`")
    return F.when(~F.isnan(c), c) if dict(df.dtypes)[column] in ("double", "float") else c


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long as doubles; a narrow projection, so only the listed columns are scanned."""
    wide = df.select(*keep, *[number_or_null(c).alias(c) for c in columns])
    return wide.unpivot(list(keep), list(columns), name, value)


def binned(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based equal-width bin, the last bin closed on the right; a zero range goes to the
    middle bin, as if it were widened on both sides."""
    pos = F.coalesce(F.floor(F.try_divide((value - lo) * F.lit(float(bins)), hi - lo)), F.lit(bins // 2))
    return F.least(pos, F.lit(bins - 1)).cast("int")
