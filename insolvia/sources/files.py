"""File scans: CSV with untidy headers, drifting columns or one file per entity; datasets by name."""
from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import nan_as_null, to_number, to_time
from ..operators.sampling import union_all
from ..store import files

# Files whose first line is read at a time.
HEADER_READERS = 16


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Apply coercing casts by column name; unreadable values become null."""
    new = {}
    for c, kind in types.items():
        if c in df.columns:
            new[c] = to_time(c) if kind in ("timestamp", "date") else to_number(c) if kind == "double" else F.col(c).try_cast(kind)
    return df.withColumns(new)


def read_csv(spark: SparkSession, path: str | Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """CSV whose header names are stripped of blanks.  Columns arrive as text and are cast
    by name, so no inference pass reads the data twice."""
    df = spark.read.option("header", True).csv(path)
    return typed(df.toDF(*[c.strip() for c in df.columns]), types or {})


def read_labelled_csv(spark: SparkSession, path: str, target: str, types: dict[str, str] | None = None) -> DataFrame:
    """Stripped header, repeated rows dropped, integer target."""
    df = read_csv(spark, path, types).dropDuplicates()
    return df.withColumn(target, F.col(target).try_cast("int")) if target in df.columns else df


def csv_paths(spark: SparkSession, folder: str) -> list[str]:
    return [f"{folder}/{n}" for n in files.names(spark, folder) if n.endswith(".csv")]


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    return tuple(c.strip() for c in next(csv.reader([files.first_line(spark, path)]), []))


def _by_header(spark: SparkSession, folder: str) -> dict[tuple[str, ...], list[str]]:
    """Paths by header.  Only first lines are read, many files at a time."""
    paths = csv_paths(spark, folder)
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        headers = list(pool.map(lambda path: _header(spark, path), paths))
    groups: dict[tuple[str, ...], list[str]] = {}
    for header, path in zip(headers, paths):
        groups.setdefault(header, []).append(path)
    return groups


def _csv_name() -> Column:
    """Name of the CSV a row came from: the file's, or that of the folder of part files (behind a partition's `name=`)."""
    part_of = F.regexp_extract("_metadata.file_path", r"/(?:[^/=]+=)?([^/]+\.csv)/[^/]+$", 1)
    return F.when(part_of != "", part_of).otherwise(F.col("_metadata.file_name"))


def _scan(spark: SparkSession, header: tuple[str, ...], paths: list[str]) -> DataFrame:
    """Files of one header; `_overflow` holds what a line has too many."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, "_overflow")])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(paths)


def read_drifting_csvs(spark: SparkSession, folder: str) -> DataFrame:
    """All CSVs of a folder by column name, with the file name as ``_source_file``.

    A CSV is a file or a folder of part files under one header.  Files sharing a header are one scan.  Lines with too many fields are skipped, short
    lines are filled with nulls.
    """
    parts = []
    for header, paths in _by_header(spark, folder).items():
        part = _scan(spark, header, paths).withColumn("_source_file", _csv_name())
        parts.append(part.filter(F.col("_overflow").isNull()).drop("_overflow"))
    return union_all(parts)


def read_entity_csvs(spark: SparkSession, folder: str, entity: str = "ticker", types: dict[str, str] | None = None) -> DataFrame:
    """One CSV (a file or a folder of part files) per entity, joined by column name whatever the order of a file's columns; the
    key is the upper-cased file name up to the first dot."""
    parts = [
        _scan(spark, header, paths).withColumn(entity, F.upper(F.split(_csv_name(), r"\.")[0])).drop("_overflow")
        for header, paths in _by_header(spark, folder).items()
    ]
    if not parts:
        raise FileNotFoundError(f"no CSV files in {folder}")
    return typed(union_all(parts), types or {})


def resolve_dataset(spark: SparkSession, folder: str, name: str) -> tuple[str, str]:
    """(format, path) of a dataset, Parquet before CSV."""
    for fmt in ("parquet", "csv"):
        if files.exists(spark, f"{folder}/{name}.{fmt}"):
            return fmt, f"{folder}/{name}.{fmt}"
    raise FileNotFoundError(f"no dataset {name} in {folder}")


def read_dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    fmt, path = resolve_dataset(spark, folder, name)
    return nan_as_null(spark.read.parquet(path)) if fmt == "parquet" else read_csv(spark, path)


def discover_datasets(spark: SparkSession, folder: str) -> list[str]:
    found = {n.rsplit(".", 1)[0] for n in files.names(spark, folder) if n.endswith((".parquet", ".csv"))}
    return sorted(found)


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    return read_dataset(spark, folder, split)
