"""Validation of a whole folder: a finding per observation, a summary row and a report per dataset.

A table's counts (missing cells, value rules, unreadable dates) come from one scan, both kinds of
duplicates from one shuffle of its distinct rows; outliers and time order have jobs of their own.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contracts import CONTRACTS, Contract, contract_for
from ..functions.scalars import present, to_number, to_time
from ..operators import quality as q
from ..session import bounded_collect
from ..sources.files import discover_datasets, read_dataset
from ..store import files

# Shares of missing cells and of outliers that make a finding.
HIGH_MISSING, MOSTLY_MISSING, MANY_OUTLIERS = 0.30, 0.90, 0.10
FINDING = "source string, check string, code string, level string, column string, value double"
SUMMARY = (
    "source string, present boolean, n_rows bigint, n_cols int, quality_score double, quality_grade string, n_errors int, n_warnings int, is_valid boolean, load_error string"
)


def table_counts(df: DataFrame, contract: Contract, as_of: str, as_of_year: int) -> dict:
    """Rows, missing cells per column, violations per value rule and unreadable times, all from one aggregate."""
    rules = q.rule_counters(df, contract, as_of, as_of_year)
    time = next((c for c in (*contract.dates, *contract.years) if c in df.columns), None)
    parsed = None if time is None else to_number(time) if time in contract.years else to_time(time, df.schema[time].dataType)
    row = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)],
        *[r[4].alias(f"r{i}") for i, r in enumerate(rules)],
        (F.count_if(parsed.isNull()) if parsed is not None else F.lit(0).cast("bigint")).alias("unread"),
    ).first()
    return {
        "n": row["n"], "time": time, "unread": row["unread"],
        "missing": {c: row[f"m{i}"] for i, c in enumerate(df.columns)},
        "rules": [(code, column, level, counted, row[f"r{i}"]) for i, (code, column, level, counted, _) in enumerate(rules)],
    }


def duplicate_totals(df: DataFrame, contract: Contract) -> tuple[int, list[tuple[str, str, int]]]:
    """Repeated rows, and (code, key, count) of repeats on the natural key.  The key is counted over the distinct rows, which
    carry how often they stand, so the table is shuffled once."""
    distinct = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    entity = contract.entity if contract.entity in df.columns else None
    dates = [c for c in (*contract.dates, *contract.years) if c in df.columns]
    if entity:
        keysets = [([entity, *dates], "duplicate_entity_timestamps" if dates else "duplicate_entity_records")]
    else:
        keysets = [([d], "duplicate_timestamps") for d in dates]
    parts = None
    for keys, code in keysets or [([], "")]:
        grouped = distinct.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.count("*").alias("_r"))
        part = grouped.agg(F.lit(code).alias("code"), F.lit(",".join(keys)).alias("key"), F.sum("_n").alias("rows"), F.sum("_r").alias("distinct"), F.count("*").alias("keys"))
        parts = part if parts is None else parts.unionByName(part)
    rows = parts.collect()  # one row per key set
    total, kinds = rows[0]["rows"] or 0, rows[0]["distinct"] or 0
    return total - kinds, [(r["code"], r["key"], (r["rows"] or 0) - (r["keys"] or 0)) for r in rows if r["code"]]


def validate_source(df: DataFrame, source: str, contract: Contract, as_of: str, as_of_year: int, seq: str | None = None) -> tuple[list[tuple], dict]:
    """Findings (check, code, level, column, value) and the summary of one table; a check that finds nothing says ok."""
    data = df.drop(seq) if seq else df
    found: list[tuple] = []

    def add(check: str, code: str, level: str, column: str = "", value: float | None = None) -> None:
        found.append((check, code, level, column, None if value is None else float(value)))

    # schema
    schema = q.schema_metrics(data, contract).first()
    kinds = q.kind_matches(data, contract)
    for c in contract.required:
        if c not in data.columns:
            add("schema", "missing_required_columns", "error", c)
    for c in contract.optional:
        if c not in data.columns:
            add("schema", "missing_optional_columns", "info", c)
    for c in sorted(set(data.columns) - set(contract.known)):
        add("schema", "unexpected_columns", "info" if contract.dynamic else "warn", c)
    for c, fits in kinds.items():
        if not fits:
            add("schema", "dtype_mismatch", "warn", c)
    # missing cells and value rules
    counts = table_counts(data, contract, as_of, as_of_year)
    n = max(counts["n"], 1)
    for c, missing in counts["missing"].items():
        share = missing / n
        if c in contract.required and share >= MOSTLY_MISSING:
            add("missing", "required_column_mostly_missing", "error", c, missing)
        elif share >= HIGH_MISSING:
            add("missing", "columns_with_high_missingness", "warn", c, missing)
        elif missing:
            add("missing", "some_missing", "info", c, missing)
    for code, column, level, _, bad in counts["rules"]:
        if bad:
            add("financial", code, level, column, bad)
    # duplicates
    repeated, keyed = duplicate_totals(data, contract)
    if repeated:
        add("duplicates", "duplicate_rows", "warn", "", repeated)
    for code, key, count in keyed:
        if count:
            add("duplicates", code, "info" if code == "duplicate_entity_records" else "warn", key, count)
    # outliers
    outliers = {r["feature"]: r["pct"] for r in bounded_collect(q.iqr_outliers(data, q.outlier_columns(data, contract)))}
    for c, pct in sorted(outliers.items()):
        if pct > MANY_OUTLIERS:
            add("outliers", "iqr_outliers", "warn", c, pct)
    # time
    timely = None
    if counts["time"]:
        time, entity = counts["time"], contract.entity if contract.entity in data.columns else None
        if counts["unread"]:
            add("timeseries", "unparseable_timestamps", "warn", time, counts["unread"])
        if entity and seq:
            order = q.timeliness(df, entity, time, seq).first().asDict()
            timely = order["timeliness_score"]
            if order["unordered_series"]:
                add("timeseries", "not_chronological", "warn", time, order["unordered_series"])
        if entity:
            again = q.duplicate_times(data, entity, time).agg(F.sum("duplicate_timestamps")).first()[0]
            if again:
                add("timeseries", "duplicate_timestamps", "warn", time, again)
            gaps = q.series_gaps(data, entity, time).agg(F.count_if(F.col("n_gaps") > 0)).first()[0]
            if gaps:
                add("timeseries", "time_gaps", "info", time, gaps)
    for check in ("schema", "missing", "duplicates", "financial", "outliers", "timeseries"):
        if not any(f[0] == check for f in found):
            add(check, "ok", "info")

    bad = sum(b for _, _, _, counted, b in counts["rules"] if counted)
    errors, warnings = (sum(f[2] == level for f in found) for level in ("error", "warn"))
    cells = n * max(len(data.columns), 1)
    base = df.sparkSession.createDataFrame(
        [(source, counts["n"], len(data.columns), schema["schema_score"], round(1 - sum(counts["missing"].values()) / cells, 4), round(1 - repeated / n, 4),
          round(max(0.0, 1 - bad / n), 4) if counts["rules"] else None, timely, sum(outliers.values()) / len(outliers) if outliers else 0.0, errors)],
        "source string, n_rows bigint, n_cols int, schema double, completeness double, uniqueness double, validity double, timeliness double, mean_iqr_pct double, n_errors int",
    )
    scored = q.quality_score(base).first()
    return found, {
        "source": source, "present": True, "n_rows": counts["n"], "n_cols": len(data.columns), "quality_score": scored["score"], "quality_grade": scored["grade"],
        "n_errors": errors, "n_warnings": warnings, "is_valid": errors == 0, "load_error": None,
    }


def validate_folder(
    spark: SparkSession, folder: str, as_of: str, as_of_year: int, contracts: dict[str, Contract] | None = None, only: Sequence[str] | None = None,
    order: dict[str, str] | None = None, reports: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Findings and summary of every dataset that is stored or has a contract.

    An absent one has a summary row alone, an unreadable one its error; neither stops the others.  ``order``
    names the ingest sequence of tables that store one.  With ``reports``, each dataset's report and the
    summary are written there as JSON.
    """
    contracts = CONTRACTS if contracts is None else contracts
    stored = set(discover_datasets(spark, folder))
    findings, summary = [], []
    for source in sorted({*contracts, *stored}):
        if only is not None and source not in only:
            continue
        row = {"source": source, "present": source in stored, "n_rows": None, "n_cols": None, "quality_score": None, "quality_grade": None, "n_errors": 0, "n_warnings": 0, "is_valid": False, "load_error": None}
        found: list[tuple] = []
        if row["present"]:
            try:
                df = read_dataset(spark, folder, source)
                found, row = validate_source(df, source, contracts.get(source) or contract_for(source), as_of, as_of_year, (order or {}).get(source))
            except Exception as exc:  # one dataset must not stop the others
                row["load_error"] = f"{type(exc).__name__}: {str(exc)[:200]}"
        findings += [(source, *f) for f in found]
        summary.append(row)
        if reports and row["present"]:
            files.write_json(spark, f"{reports}/{source}.json", {**row, "findings": [dict(zip(("check", "code", "level", "column", "value"), f)) for f in found]})
    if reports:
        totals = {"n_datasets": len(summary), "n_present": sum(r["present"] for r in summary), "n_valid": sum(r["is_valid"] for r in summary)}
        files.write_json(spark, f"{reports}/_summary.json", {"validated_at": as_of, **totals, "datasets": summary})
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    return spark.createDataFrame(findings, FINDING), spark.createDataFrame([tuple(r[c] for c in names) for r in summary], SUMMARY)
