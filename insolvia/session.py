"""Session construction, shared workspace and the few size limits the operators obey."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A window partition or a single sort task may hold at most this many rows.
# Larger groups take the chunked routes in operators/order.py instead.
TASK_ROWS_KEY = "insolvia.maxTaskRows"
TASK_ROWS_DEFAULT = 2_000_000

# A table is broadcast or collected only when it is proven to have at most this many rows.
DRIVER_ROWS_KEY = "insolvia.maxDriverRows"
DRIVER_ROWS_DEFAULT = 100_000


def build_session(app: str = "insolvia", master: str = "local[*]", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.scheduler.mode", "FAIR")  # fits run side by side, see models.in_pool
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _int_conf(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def max_task_rows(spark: SparkSession) -> int:
    return _int_conf(spark, TASK_ROWS_KEY, TASK_ROWS_DEFAULT)


def max_driver_rows(spark: SparkSession) -> int:
    return _int_conf(spark, DRIVER_ROWS_KEY, DRIVER_ROWS_DEFAULT)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one is made only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="insolvia-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_collect(df: DataFrame, limit: int | None = None) -> list:
    """Collect a table that must be small; refuse (never truncate) when it is not."""
    limit = limit or max_driver_rows(df.sparkSession)
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"result has more than {limit} rows; it must not pass through the driver")
    return rows


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the biggest group (partial aggregation first, so hot keys are cheap)."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).count().agg(F.max("count").alias("m")).first()
    return int(row["m"] or 0)
