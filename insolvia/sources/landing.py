"""Landing: gate, store raw and interim copies with a sidecar, isolate failures per source."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.quality import landing_gate
from ..store import files
from ..store.tables import write_interim, write_raw_csv, write_sidecar


@dataclass
class Landed:
    source: str
    status: str
    n_rows: int = 0
    raw_path: str | None = None
    interim_path: str | None = None
    error: str | None = None


@dataclass
class Source:
    name: str
    fetch: Callable[[SparkSession], DataFrame]
    required: Sequence[str] = ()
    clean: Callable[[DataFrame], DataFrame] = lambda df: df


def land(spark: SparkSession, source: Source, root: str, max_missing: float = 0.5) -> Landed:
    try:
        df = source.fetch(spark)
        gate = landing_gate(df, source.name, source.required, max_missing).first().asDict()
        raw = write_raw_csv(df, f"{root}/raw/{source.name}")
        interim, n = write_interim(source.clean(df), f"{root}/interim/{source.name}.parquet")
        stored = spark.read.parquet(interim)
        write_sidecar(spark, f"{root}/metadata", source.name, stored, n, raw, interim, gate)
        return Landed(source.name, "success", n, raw, interim)
    except Exception as exc:  # one source must not stop the others
        return Landed(source.name, "failed", error=f"{type(exc).__name__}: {str(exc)[:300]}")


def land_all(spark: SparkSession, sources: Sequence[Source], root: str, only: Sequence[str] | None = None) -> DataFrame:
    """Land each source and write the run manifest; returns the manifest rows."""
    results = [land(spark, s, root) if only is None or s.name in only else Landed(s.name, "skipped") for s in sources]
    files.write_json(spark, f"{root}/metadata/run_manifest.json", {"results": [asdict(r) for r in results]})
    return spark.createDataFrame(
        [tuple(asdict(r).values()) for r in results],
        "source string, status string, n_rows bigint, raw_path string, interim_path string, error string",
    )
