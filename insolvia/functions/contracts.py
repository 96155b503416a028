"""Source contracts: expected columns, keys, freshness and value rules per landed source."""
from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T


@dataclass(frozen=True)
class Contract:
    source: str
    required: dict[str, str] = field(default_factory=dict)  # column -> kind
    optional: dict[str, str] = field(default_factory=dict)
    entity: str | None = None
    dates: tuple[str, ...] = ()
    years: tuple[str, ...] = ()
    series_keys: tuple[str, ...] = ()
    freshness_days: int | None = None
    dynamic: bool = False  # extra columns are expected
    nonneg: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    ratio_bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    fiscal_year: str | None = None
    concept: str | None = None
    value: str | None = None
    concept_rules: dict[str, str] = field(default_factory=dict)
    # corpus level
    keys: tuple[str, ...] = ()
    min_rows: int = 1
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    @property
    def known(self) -> dict[str, str]:
        return {**self.required, **self.optional}

    def with_changes(self, **changes) -> "Contract":
        return replace(self, **changes)


# Fixed value: earliest plausible fiscal year.
MIN_FISCAL_YEAR = 1970

# The contracts of the ten supported sources.
CONTRACTS: dict[str, Contract] = {
    c.source: c
    for c in (
        Contract(
            "sec_edgar",
            required={"cik": "string", "entity_id": "string", "concept": "string", "value": "numeric", "date": "datetime"},
            optional={"entity_name": "string", "unit": "string", "fy": "numeric", "fp": "string", "form": "string", "filed": "any"},
            entity="entity_id", dates=("date",), series_keys=("cik", "concept"),
            fiscal_year="fy", concept="concept", value="value",
            concept_rules={"Assets": "positive", "Liabilities": "nonneg", "Revenues": "nonneg",
                           "CashAndCashEquivalentsAtCarryingValue": "nonneg"},
            keys=("cik", "concept", "date"), min_rows=10,
        ),
        Contract("kaggle_bankruptcy", required={"Bankrupt?": "integer"}, dynamic=True, min_rows=100),
        Contract(
            "fred", required={"date": "datetime"}, dates=("date",), freshness_days=400, dynamic=True,
            keys=("date",), min_rows=100,
            ranges={"Unemployment": (0, 100), "FedFundsRate": (0, 30), "Treasury10Y": (-5, 30),
                    "CPI": (0, None), "GDP": (0, None), "MoneySupplyM2": (0, None)},
        ),
        Contract(
            "yahoo_finance",
            required={"date": "datetime", "ticker": "string", "entity_id": "string", "Close": "numeric"},
            entity="entity_id", dates=("date",), series_keys=("entity_id",), freshness_days=30, dynamic=True,
            positive=("Open", "High", "Low", "Close"), nonneg=("Volume",),
            keys=("entity_id", "date"), min_rows=50,
            ranges={"Open": (0, None), "High": (0, None), "Low": (0, None), "Close": (0, None), "Volume": (0, None)},
        ),
        Contract(
            "alpha_vantage", required={"date": "datetime", "symbol": "string"}, optional={"entity_id": "string"},
            entity="entity_id", dates=("date",), series_keys=("symbol",), freshness_days=30, dynamic=True,
            positive=("open", "high", "low", "close"), nonneg=("volume",), min_rows=20,
        ),
        Contract("kaggle_news", optional={"Date": "datetime"}, dates=("Date",), dynamic=True),
        Contract(
            "kaggle_stock", required={"Date": "datetime"},
            optional={"Open": "numeric", "High": "numeric", "Low": "numeric", "Close": "numeric",
                      "Volume": "numeric", "ticker": "string"},
            entity="ticker", dates=("Date",), series_keys=("ticker",), dynamic=True,
            positive=("Open", "High", "Low", "Close"), nonneg=("Volume",),
        ),
        Contract(
            "world_bank", required={"entity_id": "string", "date": "integer"}, optional={"country": "string"},
            entity="entity_id", years=("date",), series_keys=("entity_id",), dynamic=True,
            nonneg=("GDP", "Population"), keys=("entity_id", "date"), min_rows=10,
            ranges={"Population": (0, None), "GDP": (0, None), "TradePctGDP": (0, 1000)},
        ),
        Contract(
            "imf", required={"entity_id": "string", "date": "integer", "value": "numeric"},
            entity="entity_id", years=("date",), series_keys=("entity_id",), dynamic=True,
            keys=("entity_id", "date"), min_rows=5, ranges={"value": (0, None)},
        ),
        Contract(
            "oecd", required={"entity_id": "string", "date": "any", "value": "numeric"},
            entity="entity_id", series_keys=("entity_id",), dynamic=True,
            keys=("entity_id", "date"), min_rows=5,
        ),
    )
}

# Sources held to a coverage bar in a corpus run.
COVERED = ("fred", "world_bank", "imf", "oecd", "sec_edgar", "yahoo_finance", "alpha_vantage", "kaggle_bankruptcy")


def contract_for(source: str) -> Contract:
    return CONTRACTS.get(source) or Contract(source, dynamic=True)


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def static_kind_match(kind: str, dtype: T.DataType) -> bool | None:
    """Whether a column type satisfies a kind; None when the values must be looked at."""
    if kind == "numeric":
        return isinstance(dtype, T.NumericType)
    if kind == "integer":
        return isinstance(dtype, _INTEGRAL)
    if kind == "float":
        return isinstance(dtype, _FLOATING)
    if kind == "bool":
        return isinstance(dtype, T.BooleanType)
    if kind == "string":
        return isinstance(dtype, T.StringType)
    if kind == "datetime":
        if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return True
        return None if isinstance(dtype, T.StringType) else False
    return True
