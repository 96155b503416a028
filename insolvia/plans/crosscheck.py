"""Stored sources held against their contracts: one finding per violated check, and a summary per source."""
from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contracts import CONTRACTS, Contract, contract_for
from ..operators import quality as q
from ..operators.sampling import shared_entities
from ..session import bounded_collect
from ..sources.files import discover_datasets, read_dataset
from ..store import files
from ..store.tables import verify_sidecar

FINDING = "source string, check string, level string, column string, value double"


def source_findings(df: DataFrame, contract: Contract, as_of: str, seq: str | None = None) -> list[tuple[str, str, str, float | None]]:
    """(check, level, column, value) of every violated check; at most a few per column.

    Checks: row floor, required columns, column kinds, null and repeated keys, ranges, infinities,
    age of the newest date, far-out columns and, where ``seq`` gives the stored order, time order.
    """
    found = []

    def add(check: str, level: str, column: str = "", value: float | None = None) -> None:
        found.append((check, level, column, None if value is None else float(value)))

    data = df.drop(seq) if seq else df
    floor = q.floor_and_columns(data, contract.min_rows, list(contract.required)).first()
    if floor["row_count_level"] == "FAIL":
        add("row_count", "FAIL", "", floor["n_rows"])
    for c in contract.required:
        if c not in data.columns:
            add("schema", "FAIL", c)
    for c, fits in q.kind_matches(data, contract).items():
        if not fits:
            add("kind", "WARN", c)
    keys = [c for c in contract.keys if c in data.columns]
    if keys:
        for row in bounded_collect(q.missing_counts(data.select(*keys)).where("missing > 0")):
            add("key_nulls", "FAIL", row["column"], row["missing"])
        repeated = q.duplicate_count(data, keys).first()["duplicates"]
        if repeated:
            add("key_uniqueness", "WARN", ",".join(keys), repeated)
    ranged = {c: bounds for c, bounds in contract.ranges.items() if c in data.columns}
    if ranged:
        for row in bounded_collect(q.range_violations(data, ranged).where("below + above > 0")):
            add("value_range", "FAIL", row["feature"], row["below"] + row["above"])
    for row in bounded_collect(q.infinite_columns(data).where("n_infinite > 0")):
        add("infinities", "FAIL", row["feature"], row["n_infinite"])
    date = next((c for c in contract.dates if c in data.columns), None)
    if date and contract.freshness_days is not None:
        fresh = q.freshness(data, date, contract.freshness_days, as_of).first()
        if fresh["level"] != "PASS":
            add("freshness", "WARN", date, fresh["age_days"])
    columns = [c for c in q.outlier_columns(data, contract) if c not in contract.keys]
    for row in bounded_collect(q.far_out_columns(data, columns).where("flagged")):
        add("far_out", "WARN", row["feature"], row["pct"])
    if seq and date and contract.entity in data.columns:
        unordered = q.timeliness(df, contract.entity, date, seq).first()["unordered_series"]
        if unordered:
            add("time_order", "WARN", date, unordered)
    return found


def cross_check(spark: SparkSession, folder: str, as_of: str, contracts: dict[str, Contract] | None = None, manifest: dict[str, str] | None = None, order: dict[str, str] | None = None) -> DataFrame:
    """Findings (source, check, level, column, value) of all sources that are stored, have a contract or were run.

    ``manifest`` gives the status of each source's last run, ``order`` the ingest sequence column where
    one is stored. A source without data fails when its run reported success, otherwise it is a warning;
    one that cannot be read fails; a stored table that differs from its sidecar fails; a source
    without findings has one PASS row.
    """
    contracts = CONTRACTS if contracts is None else contracts
    manifest, order = manifest or {}, order or {}
    stored, found = set(discover_datasets(spark, folder)), []
    for source in sorted({*contracts, *manifest, *stored}):
        if source not in stored:
            found.append((source, "coverage", "FAIL" if manifest.get(source) == "success" else "WARN", "", None))
            continue
        try:
            rows = source_findings(read_dataset(spark, folder, source), contracts.get(source) or contract_for(source), as_of, order.get(source))
        except (PySparkException, Py4JJavaError):
            found.append((source, "readable", "FAIL", "", None))
            continue
        if files.exists(spark, f"{folder}/{source}.meta.json") and not verify_sidecar(spark, folder, source):
            rows.append(("integrity", "FAIL", "", None))
        found += [(source, *row) for row in rows or [("summary", "PASS", "", None)]]
    return spark.createDataFrame(found, FINDING)


def corpus_checks(spark: SparkSession, folder: str, contracts: dict[str, Contract] | None = None) -> DataFrame:
    """What can only be said of several sources together: (check, level, source, value).

    ``entity_size`` is each source's number of entities, ``entity_overlap`` how many all of them share (a warning
    when none), ``corpus`` the number of readable sources (a warning, and nothing else, when fewer than two).
    """
    contracts = CONTRACTS if contracts is None else contracts
    tables: dict[str, DataFrame] = {}
    for source in discover_datasets(spark, folder):
        try:
            tables[source] = read_dataset(spark, folder, source)
        except (PySparkException, Py4JJavaError):  # cross_check reports it
            continue
    schema = "check string, level string, source string, value bigint"
    if len(tables) < 2:
        return spark.createDataFrame([("corpus", "WARN", "", len(tables))], schema)
    entity = {s: (contracts.get(s) or contract_for(s)).entity for s in tables}
    universes = {s: (df, entity[s]) for s, df in tables.items() if entity[s] in df.columns}
    shared = bounded_collect(shared_entities(universes)) if universes else []  # one row per source that has entities
    if 0 < len(shared) < len(universes):  # sources without any entity do not count
        shared = bounded_collect(shared_entities({r["source"]: universes[r["source"]] for r in shared}))
    rows = [("entity_size", "PASS", r["source"], r["n_entities"]) for r in shared]
    if len(shared) >= 2:
        common = shared[0]["n_common"]
        rows.append(("entity_overlap", "PASS" if common else "WARN", ",".join(sorted(r["source"] for r in shared)), common))
    return spark.createDataFrame([*rows, ("corpus", "PASS", "", len(tables))], schema)


def cross_summary(findings: DataFrame) -> DataFrame:
    """Findings per level and the worst level of each source."""
    fails, warns = F.count_if(F.col("level") == "FAIL"), F.count_if(F.col("level") == "WARN")
    return findings.groupBy("source").agg(
        fails.alias("n_fail"), warns.alias("n_warn"), F.when(fails > 0, "FAIL").when(warns > 0, "WARN").otherwise("PASS").alias("worst")
    )
