"""The performance history: a Parquet table of operation timings, and the queries over it."""

from __future__ import annotations

import functools
import json
import logging
import os
import platform
import re
import sys
import threading
import time
import traceback
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

logger = logging.getLogger(__name__)
KEY = ["operator", "dtype", "row_count"]
#: Environment: the default store, whether to record at all, and the label of the rows of a run.
STORE_ENV, OFF_ENV, LABEL_ENV = "PLUMBLINE_TRACES", "PLUMBLINE_NO_TRACE", "PLUMBLINE_RUN_LABEL"

TRACE = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("operator", T.StringType(), False),
        T.StructField("row_count", T.LongType(), False),
        T.StructField("dtype", T.StringType(), False),
        T.StructField("contiguous", T.IntegerType(), False),
        T.StructField("selectivity", T.DoubleType()),
        T.StructField("window", T.LongType()),
        T.StructField("available_cores", T.IntegerType(), False),
        T.StructField("selected_kernel", T.StringType(), False),
        T.StructField("runtime_ns", T.DoubleType(), False),
        T.StructField("hardware_fingerprint", T.StringType(), False),
        T.StructField("timestamp", T.DoubleType(), False),
        T.StructField("run_label", T.StringType()),
        T.StructField("call_site", T.StringType()),
    ]
)


_CPU_NAME = re.compile(r"^(?:model name|cpu model|Processor)\s*:\s*(\S.*?)\s*$", re.M)


@functools.lru_cache(maxsize=8)
def hardware_fingerprint(spark: SparkSession | None = None) -> str:
    """What a timing depends on besides the code, as JSON with sorted keys."""
    machine = platform.uname()
    told = Path("/proc/cpuinfo")
    names = _CPU_NAME.findall(told.read_text(errors="replace")) if told.is_file() else []
    facts = {
        # fixed names of the facts that must be comparable between stores
        "system": machine.system,
        "machine": machine.machine,
        "cpu_model": next(iter(names), machine.processor or "unknown"),
        "cpu_count": os.cpu_count() or 1,
        "python_version": platform.python_version(),
        "numpy_version": np.__version__,
    }
    if spark is not None:
        sc = spark.sparkContext
        facts |= {"spark_version": spark.version, "master": sc.master, "parallelism": sc.defaultParallelism, "executor_cores": sc.getConf().get("spark.executor.cores", "")}
    return json.dumps(facts, sort_keys=True)


def call_site() -> str | None:
    """file:line of the nearest caller whose module is not of this package; none if there is none."""
    package = __name__.partition(".")[0]
    callers = traceback.walk_stack(sys._getframe(1))
    outside = ((frame.f_code.co_filename, line) for frame, line in callers if frame.f_globals.get("__name__", "").partition(".")[0] != package)
    return next((f"{Path(file).name}:{line}" for file, line in outside), None)


class TraceStore:
    """An append-only table, in a folder for each run label. Rows are buffered and written at each flush.

    A reader of one label reads its folder only.  A failed write is logged, never raised.  A missing
    table reads as an empty one, and columns that older files lack read as null; files of older
    versions that lie beside the folders are read, too.  ``compact`` joins the small files of the flushes.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, profile: bool = False, flush_rows: int = 10_000):
        self.spark, self.profile, self.flush_rows = spark, profile, flush_rows
        self.path = path or os.environ.get(STORE_ENV) or os.path.join(os.path.expanduser("~"), ".plumbline", "traces")
        self.enabled = not os.environ.get(OFF_ENV) and spark.conf.get("spark.plumbline.trace.enabled", "true") == "true"
        self._rows: list[tuple] = []
        self._lock = threading.Lock()
        self._label: str | None = None

    @contextmanager
    def labelled(self, label: str):
        """Rows recorded inside carry ``label``."""
        before, self._label = self._label, label
        try:
            yield self
        finally:
            self._label = before

    def record(self, operator: str, row_count: int, dtype: str, *, contiguous: int, selected_kernel: str, runtime_ns: float, available_cores: int | None = None, selectivity: float | None = None, window: int | None = None, run_label: str | None = None, call_site: str | None = None) -> None:
        if not self.enabled:
            return
        label = run_label or self._label or os.environ.get(LABEL_ENV)
        site = call_site or globals()["call_site"]()
        row = (time.time_ns(), operator, int(row_count), dtype, int(contiguous), selectivity, window, available_cores or os.cpu_count() or 1, selected_kernel, float(runtime_ns), hardware_fingerprint(self.spark), time.time(), label, site)
        with self._lock:
            self._rows.append(row)
            full = len(self._rows) >= self.flush_rows
        if full:
            self.flush()

    def flush(self) -> None:
        with self._lock:
            rows, self._rows = self._rows, []
        if not rows:
            return
        try:
            self.spark.createDataFrame(rows, TRACE).coalesce(1).write.mode("append").partitionBy("run_label").parquet(self._labels)
        except Exception:
            logger.warning("plumbline: the traces could not be written", exc_info=True)

    @property
    def _labels(self) -> str:
        return f"{self.path.rstrip('/')}/labels"

    def _found(self, pattern: str) -> bool:
        """Whether there are files of this pattern in any of Spark's file systems."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        return bool(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))

    def traces(self) -> DataFrame:
        """All traces; a condition on ``run_label`` reads the folders of those labels only."""
        out = [migrated(self.spark.read.schema(TRACE).parquet(self._labels))] if self._found(f"{self._labels}/run_label=*") else []
        if self._found(f"{self.path}/*.parquet"):
            out.append(migrated(self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/*.parquet")))
        return functools.reduce(DataFrame.union, out) if out else self.spark.createDataFrame([], TRACE)

    def compact(self, label: str) -> None:
        """Writes the rows of ``label`` anew, in one file; no other process may write that label meanwhile."""
        from plumbline.plans.materialize import table

        own = table(labelled(self.traces(), label), "traces")
        own.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_label").parquet(self._labels)


def migrated(traces: DataFrame) -> DataFrame:
    """``traces`` with all columns of the schema; missing ones are null."""
    return traces.select(*(F.col(f"`{f.name}`").cast(f.dataType) if f.name in traces.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TRACE))


def labelled(traces: DataFrame, label: str) -> DataFrame:
    return traces.where(F.col("run_label") == label)


def samples(traces: DataFrame, label: str, *, by_call_site: bool = False) -> DataFrame:
    """The run times of each operator, dtype and row count under a label, or of each of their call sites."""
    return labelled(traces, label).groupBy(*KEY, *["call_site"] * by_call_site).agg(F.sort_array(F.collect_list("runtime_ns")).alias("samples"), F.count("*").alias("n"))


def fingerprints(traces: DataFrame, label: str) -> DataFrame:
    return labelled(traces, label).select("hardware_fingerprint").distinct()


def hardware_confound(traces: DataFrame, baseline: str, current: str) -> DataFrame:
    """One row: the warnings that machines differ between the two labels or within the current one."""
    sets = traces.where(F.col("run_label").isin(baseline, current)).agg(
        F.coalesce(F.sort_array(F.collect_set(F.when(F.col("run_label") == baseline, F.col("hardware_fingerprint")))), F.array().cast("array<string>")).alias("b"),
        F.coalesce(F.sort_array(F.collect_set(F.when(F.col("run_label") == current, F.col("hardware_fingerprint")))), F.array().cast("array<string>")).alias("c"),
    )
    differ = F.when((F.size("b") > 0) & (F.size("c") > 0) & (F.col("b") != F.col("c")), F.lit("baseline and current runs used different hardware"))
    mixed = F.when(F.size("c") > 1, F.lit("the current runs used more than one hardware"))
    return sets.select(F.size("b").cast("long").alias("n_baseline"), F.size("c").cast("long").alias("n_current"), F.concat_ws("\n", differ, mixed).alias("warning"))


def first_contiguity_loss(traces: DataFrame, label: str) -> DataFrame:
    """The earliest trace of each key that left the fast path, with its call site."""
    first = Window.partitionBy(*KEY).orderBy("timestamp", "id")
    lost = labelled(traces, label).where("contiguous = 0").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return lost.select(*KEY, "call_site", "timestamp")


def contiguous_samples(traces: DataFrame) -> DataFrame:
    """The run times on the fast path under any label."""
    return traces.where("contiguous = 1").groupBy(*KEY).agg(F.sort_array(F.collect_list("runtime_ns")).alias("accelerated"))


def average_selectivity(traces: DataFrame) -> DataFrame:
    """The mean selectivity of each filter shape over all labels."""
    return traces.where("operator = 'filter' and selectivity is not null").groupBy("dtype", "row_count").agg(F.avg("selectivity").alias("selectivity"))


def kernel_log(traces: DataFrame) -> DataFrame:
    """How often each call site ran with which kernel, and over how many rows; unknown sites first."""
    keys = ["call_site", "operator", "dtype", "selected_kernel"]
    return traces.groupBy(*keys).agg(F.count("*").alias("calls"), F.min("row_count").alias("min_rows"), F.max("row_count").alias("max_rows")).orderBy(*(F.asc_nulls_first(k) for k in keys))


def profile(traces: DataFrame, label: str) -> DataFrame:
    """The share of each key in the whole run time, the largest first."""
    from plumbline.functions.numeric import upper_median

    own = labelled(traces, label).groupBy(*KEY).agg(F.sum("runtime_ns").alias("total_ns"), upper_median("runtime_ns").alias("median_ns"), F.count("*").alias("calls"))
    whole = own.agg(F.sum("total_ns").alias("_all"))
    share: Column = F.coalesce(F.try_divide(F.lit(100.0) * F.col("total_ns"), F.col("_all")), F.lit(0.0))
    return own.join(F.broadcast(whole)).select(*KEY, "total_ns", "median_ns", "calls", share.alias("percent")).orderBy(F.desc("total_ns"), *KEY)


def stage_breakdown(stages: DataFrame) -> DataFrame:
    """(run, stage, accelerated, ns) by stage: totals, upper medians and shares of the whole."""
    from plumbline.functions.numeric import upper_median

    own = stages.groupBy("stage").agg(F.sum("ns").alias("total_ns"), F.sum(F.when(F.col("accelerated"), F.col("ns")).otherwise(0.0)).alias("accelerated_ns"), upper_median("ns").alias("median_ns"))
    whole = own.agg(F.sum("total_ns").alias("_all"))
    return own.join(F.broadcast(whole)).select("stage", "total_ns", "accelerated_ns", "median_ns", F.coalesce(F.try_divide("total_ns", "_all"), F.lit(0.0)).alias("share")).orderBy(F.desc("total_ns"), "stage")
