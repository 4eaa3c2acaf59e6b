"""Performance history as a stream: an extension for long-running services."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import numeric
from plumbline.sources.traces import TRACE


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New trace files as they arrive."""
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def transformed(stream: DataFrame, scale: float, offset: float, threshold: float) -> DataFrame:
    """The elementwise operators, which need no state, on a stream's run times."""
    x = numeric.affine(F.col("runtime_ns"), scale, offset)
    return stream.withColumn("runtime_ns", x).where(numeric.above(F.col("runtime_ns"), threshold))


def runtimes_by_window(stream: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean run time by operator and time window; rows later than ``late`` are dropped."""
    timed = stream.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "operator", "dtype").agg(F.avg("runtime_ns").alias("mean_ns"), F.count("*").alias("calls"))
