"""Choice of an execution strategy from an operator's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows from which several threads pay, and the selectivities for which vectors pay in filters.
PARALLEL_ROWS, SELECTIVE = 5_000_000, (0.3, 0.7)
DEFAULT_SELECTIVITY = 0.5


def select_kernel(operator: Column, rows: Column, threads: Column, selectivity: Column | None = None) -> Column:
    """scalar, avx2 or mt_avx2; a selectivity that is unknown or outside [0, 1] counts as a half."""
    share = F.lit(None) if selectivity is None else selectivity
    share = F.when(share.between(0.0, 1.0), share).otherwise(F.lit(DEFAULT_SELECTIVITY))
    vectors = F.when((rows >= PARALLEL_ROWS) & (threads > 1), F.lit("mt_avx2")).otherwise(F.lit("avx2"))
    return F.when(operator == "reduction", vectors).when((operator == "filter") & share.between(*SELECTIVE), vectors).otherwise(F.lit("scalar"))


def selected(shapes: DataFrame, traces: DataFrame, threads: int) -> DataFrame:
    """Adds to (operator, dtype, row_count) the mean selectivity seen before and the kernel chosen by it."""
    from plumbline.sources.traces import average_selectivity

    seen = average_selectivity(traces).withColumn("operator", F.lit("filter"))
    out = shapes.join(seen, ["operator", "dtype", "row_count"], "left")
    return out.withColumn("kernel", select_kernel(F.col("operator"), F.col("row_count"), F.lit(threads), F.col("selectivity")))
