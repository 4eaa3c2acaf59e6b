"""A sweep of the operators over sizes and parameters: medians of repeated runs, as a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.series import Series

COLUMNS = "operation string, kernel string, dtype string, n long, param double, median_ns double"


def _timed(run: Callable[[], object], repeats: int) -> float:
    took = []
    for _ in range(repeats):
        began = time.perf_counter_ns()
        run()
        took.append(time.perf_counter_ns() - began)
    took.sort()
    return (took[(repeats - 1) // 2] + took[repeats // 2]) / 2


def _cases(s: Series, selectivities: tuple[float, ...], windows: tuple[int, ...]) -> Iterator[tuple[str, float, Callable[[], object]]]:
    drained = lambda out: out.df.write.format("noop").mode("overwrite").save()
    yield "reduction", 0.0, s.sum
    yield "projection", 2.5, lambda: drained(s.project_affine(2.5, -1.5))
    for share in selectivities:
        yield "filter", share, lambda share=share: drained(s.filter_gt(1 - share))
    for window in windows:
        yield "rolling", float(window), lambda window=window: drained(s.rolling_sum(window))


def sweep(spark: SparkSession, sizes: tuple[int, ...], *, selectivities: tuple[float, ...] = (0.1, 0.5, 0.9), windows: tuple[int, ...] = (5, 20, 500), repeats: int = 5, seed: int = 1) -> DataFrame:
    """One row for each operator, type, size and parameter; ``write.csv`` makes a file of it."""
    rows = []
    for n in sizes:
        for dtype, kind in (("float64", "double"), ("float32", "float")):
            data = spark.range(n).select("id", F.rand(seed).cast(kind).alias("x")).cache()
            data.count()
            for operation, param, run in _cases(Series(data, "x", "id"), selectivities, windows):
                rows.append((operation, "spark", dtype, n, param, _timed(run, repeats)))
            data.unpersist()
    return spark.createDataFrame(rows, COLUMNS)
