"""An ordered float column of a DataFrame and the operators on it."""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import numeric
from plumbline.operators import ordering
from plumbline.operators.ordering import ROW, windowed


class UnsupportedDTypeError(TypeError):
    """The value column is neither float nor double; nothing is converted silently."""


class Series:
    """``value`` of ``df`` in the order of ``order_by``, alone or for each of ``partition_by``.

    Operators are lazy and keep the order columns; ``sum``, ``mean`` and ``len`` are actions, which
    ``np.sum`` and ``np.mean`` reach, too.  Rows of null values are left out, or rejected at the first
    action with ``nulls="reject"``, in the data and in what ``map`` and ``zip_with`` make of them; NaN
    and infinities are data and stay in their places.  The values of ``order_by`` must be unique within
    a partition.  ``tracer`` records the actions' run times.
    """

    def __init__(self, df: DataFrame, value: str, order_by: str | Sequence[str], partition_by: str | Sequence[str] = (), *, nulls: str = "drop", strategy: str = "auto", tracer=None):
        kind = df.schema[value].dataType
        if not isinstance(kind, (T.FloatType, T.DoubleType)):
            raise UnsupportedDTypeError(f"{value} is {kind.simpleString()}; float or double is needed")
        self.dtype = "float32" if isinstance(kind, T.FloatType) else "float64"
        self.value = value
        self.order = [order_by] if isinstance(order_by, str) else list(order_by)
        self.by = [partition_by] if isinstance(partition_by, str) else list(partition_by)
        self.strategy, self.tracer, self.nulls = strategy, tracer, nulls
        self.df = self._checked(df)
        self._rows: int | None = None
        self._most: list[int] = []  # the largest partition's rows, shared with all that is derived

    def _checked(self, df: DataFrame) -> DataFrame:
        held = self.x.isNotNull()
        if not df.schema[self.value].nullable:
            return df
        return df.where(held) if self.nulls == "drop" else df.withColumn(self.value, F.when(held, self.x).otherwise(F.raise_error(F.lit(f"{self.value} has nulls"))))

    def _with(self, df: DataFrame, *, checked: bool = True) -> Series:
        out = copy.copy(self)
        out._rows = None
        kind = df.schema[self.value].dataType
        if not isinstance(kind, (T.FloatType, T.DoubleType)):
            raise UnsupportedDTypeError(f"{self.value} became {kind.simpleString()}; float or double is needed")
        out.dtype = "float32" if isinstance(kind, T.FloatType) else "float64"
        out.df = df if checked else out._checked(df)
        return out

    def most(self) -> int:
        """The rows of the largest partition: counted once for a series and all that is derived from it, none of which has more."""
        if not self._most:
            self._most.append(self.df.groupBy(*self.by).count().agg(F.max("count")).first()[0] or 0 if self.by else self.df.count())
        return self._most[0]

    @property
    def x(self) -> Column:
        return F.col(self.value)

    def __len__(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    @property
    def shape(self) -> tuple[int]:
        return (len(self),)

    def __repr__(self) -> str:
        return f"Series({self.value}: {self.dtype}, ordered by {', '.join(self.order)})"

    def to_df(self) -> DataFrame:
        return self.df

    def to_numpy(self) -> np.ndarray:
        """The values in order, on the driver."""
        rows = self.df.select(*self.by, *self.order, self.value).orderBy(*self.by, *self.order)
        return rows.select(self.value).toPandas()[self.value].to_numpy(np.float32 if self.dtype == "float32" else np.float64)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        out = self.to_numpy()
        return out if dtype is None else out.astype(dtype)

    def _traced(self, operator: str, run: Callable, **details):
        if self.tracer is None or not self.tracer.enabled:
            return run()
        rows, began = len(self), time.perf_counter_ns()
        out = run()
        self.tracer.record(operator, rows, self.dtype, contiguous=1, selected_kernel="spark", runtime_ns=float(time.perf_counter_ns() - began), **{k: v(out) if callable(v) else v for k, v in details.items()})
        return out

    def _eager(self, operator: str, out: Series, **details) -> Series:
        """In profile mode each operator runs by itself; that breaks fusion but gives it a time."""
        if self.tracer is not None and self.tracer.profile:
            self._traced(operator, lambda: out.df.write.format("noop").mode("overwrite").save(), **details)
        return out

    def sum_df(self) -> DataFrame:
        return self.df.groupBy(*self.by).agg(numeric.total(self.x).alias("sum"))

    def mean_df(self) -> DataFrame:
        """Null for an empty series."""
        return self.df.groupBy(*self.by).agg(F.avg(self.x.cast("double")).alias("mean"))

    @staticmethod
    def _whole(axis, out, more) -> None:
        """What NumPy's functions pass on: a series has one axis, and its results are new."""
        if axis not in (None, 0, -1, (0,)) or out is not None or any(v is not np._NoValue for v in more.values()):
            raise ValueError("a series is reduced over its one axis, without out, where, initial or keepdims")

    def sum(self, axis=None, dtype=None, out=None, **more) -> float:
        """The sum in double; 0.0 for an empty series."""
        self._whole(axis, out, more)
        found = self._traced("reduction", lambda: self.df.agg(numeric.total(self.x)).first()[0])
        return found if dtype is None else np.dtype(dtype).type(found)

    def mean(self, axis=None, dtype=None, out=None, **more) -> float:
        """The mean in double; an empty series raises ValueError."""
        self._whole(axis, out, more)
        found = self._traced("reduction", lambda: self.df.agg(F.avg(self.x.cast("double"))).first()[0])
        if found is None:
            raise ValueError("mean of an empty series")
        return found if dtype is None else np.dtype(dtype).type(found)

    def std(self, axis=None, dtype=None, out=None, ddof=0, **more) -> float | None:
        """The standard deviation of the population, or with ``ddof=1`` of a sample; null for an empty series."""
        self._whole(axis, out, more)
        if ddof not in (0, 1):
            raise ValueError("ddof must be 0 or 1")
        found = self.df.agg((F.stddev_samp if ddof else F.stddev_pop)(self.x.cast("double"))).first()[0]
        return found if dtype is None or found is None else np.dtype(dtype).type(found)

    def agg_by(self, *keys: str) -> DataFrame:
        """Sums for each value of ``keys``: the axis-wise sum of long-form data."""
        return self.df.groupBy(*keys).agg(numeric.total(self.x).alias("sum"))

    def project_affine(self, scale: float, offset: float) -> Series:
        return self._eager("projection", self._with(self.df.withColumn(self.value, numeric.affine(self.x, scale, offset, self.dtype))))

    def filter_gt(self, threshold: float) -> Series:
        """Values strictly above ``threshold``, in order; NaN never passes."""
        out = self._with(self.df.where(numeric.above(self.x, threshold, self.dtype)))
        return self._eager("filter", out, selectivity=lambda _: len(out) / len(self) if len(self) else None)

    def map(self, make: Callable[[Column], Column]) -> Series:
        """Any elementwise expression; the result must again be float or double."""
        return self._with(self.df.withColumn(self.value, make(self.x)), checked=False)

    def zip_with(self, other: Series, make: Callable[[Column, Column], Column]) -> Series:
        """Combines the values of equal order and partition columns."""
        keys = self.by + self.order
        name = self._free("_other")
        right = other.df.select(*(F.col(o).alias(k) for k, o in zip(keys, other.by + other.order)), F.col(other.value).alias(name))
        return self._with(self.df.join(right, keys).withColumn(self.value, make(self.x, F.col(name))).drop(name), checked=False)

    def _free(self, name: str) -> str:
        """``name``, with underscores in front until no column has it."""
        while name.lower() in (c.lower() for c in self.df.columns):
            name = f"_{name}"
        return name

    def _windowed(self, width: int, make: Callable) -> tuple[DataFrame, str]:
        row = self._free(ROW)
        return windowed(self.df, self.order, self.by, width, make, self.strategy, most=self.most, row=row), row

    def every(self, step: int, start: int = 0) -> Series:
        """Each ``step``-th value by position."""
        rows, row = self._windowed(1, lambda w: {})
        return self._with(rows.where((F.col(row) >= start) & ((F.col(row) - start) % step == 0)).drop(row))

    def _rolled(self, window: int, make: Callable[[Column, object], Column], finish: Callable[[Column, Column], Column], spread: bool = False) -> Series:
        """``make`` tells the result from the values of a frame, ``finish`` from a wide one's sum and, with ``spread``, sum of squared deviations."""
        if window < 0:
            raise ValueError("window must not be negative")
        kind = self.df.schema[self.value].dataType
        if window == 0:
            return self._with(self.df.limit(0))
        if window > ordering.FRAME_ROWS:
            return self._rolled_wide(window, finish, spread)
        name = self._free("_out")
        rows, row = self._windowed(window, lambda w: {name: make(self.x.cast("double"), w.rowsBetween(1 - window, 0)).cast(kind)})
        return self._with(rows.where(F.col(row) >= window - 1).withColumn(self.value, F.col(name)).drop(name, row))

    def _rolled_wide(self, window: int, finish: Callable[[Column, Column], Column], spread: bool) -> Series:
        # no partition has so many rows; where nulls are rejected, the data must still be looked at
        if self.nulls == "drop" and window > self.most():
            return self._with(self.df.limit(0))
        kind = self.df.schema[self.value].dataType
        row, total, m2 = self._free(ROW), self._free("_total"), self._free("_m2")
        rows = ordering.wide_sums(self.df, self.value, self.order, self.by, window, row, total, m2 if spread else None, self.strategy, self.most)
        return self._with(rows.withColumn(self.value, finish(F.col(total), F.col(m2)).cast(kind)).drop(row, total, m2))

    def rolling_sum(self, window: int) -> Series:
        """Sums of ``window`` neighbours, at the last one's place; no partial windows; window 0 is empty."""
        return self._eager("rolling", self._rolled(window, lambda x, w: F.sum(x).over(w), lambda total, _: total), window=window)

    def rolling_mean(self, window: int) -> Series:
        kind = self.df.schema[self.value].dataType
        mean = lambda total: total.cast(kind) / numeric.literal(window, self.dtype)
        return self._eager("rolling", self._rolled(window, lambda x, w: mean(F.sum(x).over(w)), lambda total, _: mean(total)), window=window)

    def rolling_var(self, window: int) -> Series:
        return self._rolled(window, lambda x, w: F.var_pop(x).over(w), lambda _, m2: m2 / window, spread=True)

    def rolling_std(self, window: int) -> Series:
        return self._rolled(window, lambda x, w: F.stddev_pop(x).over(w), lambda _, m2: F.sqrt(m2 / window), spread=True)

    def _lagged(self, make: Callable[[Column, Column], Column]) -> Series:
        name = self._free("_last")
        rows, row = self._windowed(2, lambda w: {name: F.lag(self.x).over(w)})
        return self._with(rows.where(F.col(row) >= 1).withColumn(self.value, make(self.x, F.col(name))).drop(name, row))

    def diff(self) -> Series:
        """Differences from the value before; one value fewer."""
        return self._lagged(lambda x, last: x - last)

    def log(self) -> Series:
        """Natural logarithms: minus infinity of 0 and NaN of what is below, each in its place."""
        return self._with(self.df.withColumn(self.value, numeric.ln(self.x)))

    def diff_log(self) -> Series:
        """Differences of the logarithms; those beside values of 0 or less are infinite or NaN, and stay in their places."""
        return self._lagged(lambda x, last: numeric.ln(x) - numeric.ln(last))

    def zscore(self) -> Series:
        """(x - mean) / population standard deviation; NaN throughout if that is 0."""
        mean, std = self._free("_mean"), self._free("_std")
        stats = self.df.groupBy(*self.by).agg(F.avg(self.x).alias(mean), F.stddev_pop(self.x).alias(std))
        joined = self.df.join(stats, self.by) if self.by else self.df.join(F.broadcast(stats))  # one row
        return self._with(joined.withColumn(self.value, numeric.zscore(self.x, F.col(mean), F.col(std))).drop(mean, std))

    def running_sum(self, exclusive: bool = False) -> Series:
        """Prefix sums; the exclusive ones start with 0."""
        from plumbline.operators.prefix import prefix_sums

        return self._with(prefix_sums(self.df, self.value, self.order, self.by, exclusive=exclusive, most=self.most))
