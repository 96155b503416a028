"""Structured Streaming: row-local scoring and windowed request metrics."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.scoring import request_aggregates
from ..session import new_path


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def windowed_requests(log: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Request metrics per tumbling window.  State holds one row per open window; rows later
    than the watermark are dropped and closed windows are emitted once."""
    w = F.window(ts, width)
    out = log.withWatermark(ts, late).groupBy(w).agg(*request_aggregates())
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *out.columns[1:])


def run_available(df: DataFrame, label: str) -> DataFrame:
    """Drain what is available into Parquet with a checkpoint in the shared folder."""
    spark = df.sparkSession
    out, state = new_path(spark, label), new_path(spark, f"{label}-state")
    q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
