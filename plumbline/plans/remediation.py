"""Whether a copy to the fast path would pay."""

from __future__ import annotations

import functools
import time

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import byte_size

NO_HISTORY = "no run on the fast path is known for this shape"


@functools.lru_cache(maxsize=1)
def copy_bytes_per_ns(elements: int = 10_000_000, runs: int = 5) -> float:
    """How fast strided float64 data are copied here: the median of a few timings."""
    data = np.zeros(2 * elements)[::2]
    took = []
    for _ in range(runs):
        began = time.perf_counter_ns()
        np.ascontiguousarray(data)
        took.append(time.perf_counter_ns() - began)
    return elements * 8 / sorted(took)[runs // 2]


def copy_cost(rows: Column, dtype: Column, bytes_per_ns: float) -> Column:
    """Nanoseconds; infinite if nothing can be copied."""
    return F.lit(float("inf")) if bytes_per_ns <= 0 else byte_size(dtype, rows) / F.lit(float(bytes_per_ns))


def _upper(xs: Column) -> Column:
    return F.get(F.sort_array(xs), (F.size(xs) / 2).cast("int"))


def remediation(shapes: DataFrame, bytes_per_ns: float, margin: float = 2.0) -> DataFrame:
    """Adds costs, savings and advice to (operator, dtype, row_count, samples, accelerated).

    Savings are the difference of the upper medians; a copy is advised if they exceed its cost
    ``margin`` times.  Without accelerated history there is no estimate, only a reason.
    """
    known = F.coalesce(F.size("accelerated"), F.lit(0)) > 0
    cost = copy_cost(F.col("row_count"), F.col("dtype"), bytes_per_ns)
    saved = F.when(known, _upper(F.col("samples")) - _upper(F.col("accelerated")))
    out = shapes.withColumn("copy_cost_ns", cost).withColumn("savings_ns", saved)
    return out.select(
        *shapes.columns,
        "copy_cost_ns",
        "savings_ns",
        (F.col("savings_ns") - F.col("copy_cost_ns")).alias("net_benefit_ns"),
        F.coalesce(F.col("savings_ns") > F.col("copy_cost_ns") * margin, F.lit(False)).alias("recommend"),
        F.when(~known, F.lit(NO_HISTORY)).alias("reason"),
    )
