"""Elementwise, windowed and array-valued expressions over float and double columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTHS = {"float32": 4, "float64": 8}
_TYPES = {"float32": "float", "float64": "double"}


def literal(value: float, dtype: str) -> Column:
    """``value`` in the column's own type, so that float32 arithmetic isn't widened."""
    return F.lit(float(value)).cast(_TYPES[dtype])


def affine(x: Column, scale: float, offset: float, dtype: str = "float64") -> Column:
    return (x * literal(scale, dtype) + literal(offset, dtype)).cast(_TYPES[dtype])


def above(x: Column, threshold: float, dtype: str = "float64") -> Column:
    """Strictly greater; NaN never passes, though Spark orders it above all numbers."""
    return (x > literal(threshold, dtype)) & ~F.isnan(x)


def selectivity(passed: Column) -> Column:
    """The share of rows that pass: null without rows."""
    return F.try_divide(F.count_if(passed).cast("double"), F.count(F.lit(1)))


def total(x: Column) -> Column:
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def upper_median(name: str) -> Column:
    """The element at position n div 2 of the sorted values: the first half of them from above."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)")


def ln(x: Column) -> Column:
    """The natural logarithm; minus infinity of 0, NaN of what is below."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """NaN where the standard deviation is 0, as all values are equal there."""
    return F.when(std == 0, F.lit(float("nan"))).otherwise((x - mean) / F.when(std != 0, std))


def byte_size(dtype: Column, rows: Column) -> Column:
    return F.when(dtype.contains("float64"), 8).otherwise(4) * rows


def close(got: Column, want: Column, tolerance: float) -> Column:
    """Whether |got - want| is within ``tolerance`` of max(|want|, 1); equal infinities are, and two NaN are."""
    return (got == want) | F.coalesce(F.abs(got - want) / F.greatest(F.abs(want), F.lit(1.0)) <= tolerance, F.lit(False))


def percent(x: Column) -> Column:
    return F.format_string("%+.1f%%", x * 100)


def milliseconds(ns: Column) -> Column:
    return F.format_string("%.2fms", ns / 1e6)


def array_affine(a: Column, scale: float, offset: float) -> Column:
    return F.transform(a, lambda x: affine(x, scale, offset, "float32"))


def array_above(a: Column, threshold: float) -> Column:
    return F.filter(a, lambda x: above(x, threshold, "float32"))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_rolling_sum(a: Column, window: int) -> Column:
    """Sums of every ``window`` neighbours; none for window 0 or a window longer than the array."""
    none = F.array().cast("array<float>")
    if window <= 0:
        return none
    each = F.transform(F.sequence(F.lit(1), F.size(a) - window + 1), lambda i: array_sum(F.slice(a, i, F.lit(window))).cast("float"))
    return F.when(F.size(a) >= window, each).otherwise(none)
