"""Prefix sums over a whole ordered table in two passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ordering import BLOCK_ROWS, ROW, SINGLE_TASK_ROWS, numbered


def prefix_sums(df: DataFrame, value: str, order: list[str], by: list[str], *, exclusive: bool = False, block: int = BLOCK_ROWS, single: int = SINGLE_TASK_ROWS, most: Callable[[], int] | None = None) -> DataFrame:
    """``value`` replaced by its running total within ``by``; blocks are summed alone and offset by those before.

    Groups of up to ``single`` rows (``most`` tells the largest) are left to one task each.
    """
    last = -1 if exclusive else 0
    running = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, last)), F.lit(0.0))
    kind = df.schema[value].dataType
    largest = most() if most else df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0 if by else df.count()
    if largest <= single:
        return df.withColumn(value, running(Window.partitionBy(*by).orderBy(*order)).cast(kind))
    rows = numbered(df, [*by, *order]).withColumn("_block", F.floor(F.col(ROW) / block))
    sums = rows.groupBy("_block", *by).agg(F.sum(value).alias("_sum"))  # a row for each block of a group
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*by).orderBy("_block")) - F.col("_sum"))
    before = before.select(*(F.col(k).alias(f"_by_{k}") for k in by), F.col("_block").alias("_own"), "_before")
    inside = running(Window.partitionBy("_block", *by).orderBy(ROW))
    same = [F.col("_block") == F.col("_own"), *(F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by)]
    joined = rows.withColumn("_in", inside).join(before, same)
    return joined.withColumn(value, (F.col("_before") + F.col("_in")).cast(kind)).drop("_block", "_own", "_in", "_before", ROW, *(f"_by_{k}" for k in by))
