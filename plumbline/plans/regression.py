"""Bootstrap intervals of relative slowdowns and the decisions based on them."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.materialize import ship
from plumbline.sources.traces import KEY, contiguous_samples, first_contiguity_loss, samples


class InsufficientDataError(ValueError):
    """Fewer than two samples on a side."""


def bounds(n_bootstrap: int, ci: float) -> tuple[int, int]:
    """The 0-based places of an interval's ends among sorted resamples."""
    alpha = 1 - ci
    return int(n_bootstrap * (alpha / 2)), min(int(n_bootstrap * (1 - alpha / 2)), n_bootstrap - 1)


def bonferroni(comparisons: int) -> float:
    return 1 - 0.05 / max(comparisons, 1)


def slowdown(baseline: list[float], current: list[float]) -> float:
    """(mean of current - mean of baseline) / mean of baseline; 0 for a baseline of mean 0."""
    b = sum(baseline) / len(baseline)
    return (sum(current) / len(current) - b) / b if b else 0.0


def bootstrap(baseline: list[float], current: list[float], n_bootstrap: int = 10_000, ci: float = 0.95, seed: int | None = None) -> tuple[float, float, float]:
    """(estimate, low, high) by resampling both sides independently: the driver's version."""
    if min(len(baseline), len(current)) < 2:
        raise InsufficientDataError("two samples a side are needed")
    rng = random.Random(seed)
    draws = sorted(slowdown(rng.choices(baseline, k=len(baseline)), rng.choices(current, k=len(current))) for _ in range(n_bootstrap))
    low, high = bounds(n_bootstrap, ci)
    return slowdown(baseline, current), draws[low], draws[high]


def evaluate(baseline: list[float], current: list[float], *, min_pairs: int = 20, threshold: float = 0.05, comparisons: int = 1, n_bootstrap: int = 10_000, seed: int | None = None) -> dict:
    """insufficient_data, regression (the interval lies above the threshold) or within_noise."""
    out = {"n_baseline": len(baseline), "n_current": len(current), "status": "insufficient_data", "ci_low": None, "ci_high": None, "estimate": None}
    if min(len(baseline), len(current)) < min_pairs:
        return out
    estimate, low, high = bootstrap(baseline, current, n_bootstrap, bonferroni(comparisons), seed)
    return out | {"estimate": estimate, "ci_low": low, "ci_high": high, "status": "regression" if low > threshold else "within_noise"}


#: Blocks of draws at least, each of which is one task of the resampling, and numbers drawn at once.
BLOCKS, DRAWN_AT_ONCE = 48, 1 << 15
_PRIME = 2147483647
#: Steps from a draw, and from a pick, to the next; draws that are ``_PICK`` apart follow one course, ``_DRAW`` picks apart.
_DRAW, _PICK = 65537, 257


def _mixed(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Two rounds of ``x`` * factor + shift and ``x`` * ``x`` + shift modulo _PRIME, a number of 31 ones, in place.

    Numbers of 0 to 2**62 stay below 2**63 all the way, so a remainder is only made least at the end.
    """

    def fold() -> None:
        np.right_shift(x, 31, out=spare)
        np.bitwise_and(x, _PRIME, out=x)
        np.add(x, spare, out=x)

    fold()
    for factor, shift in ((48271, 11), (69621, 12345)):
        np.multiply(x, factor, out=x)
        np.add(x, shift, out=x)
        fold()
        np.multiply(x, x, out=x)
        np.add(x, shift, out=x)
        fold()
    fold()  # now _PRIME + 2 at most
    np.add(x, 1, out=spare)
    np.right_shift(spare, 31, out=spare)
    np.add(x, spare, out=x)
    return np.bitwise_and(x, _PRIME, out=x)


def places(draws: np.ndarray, picks: np.ndarray, n: int, salt: int) -> np.ndarray:
    """The places of the numbered picks of the numbered draws among ``n`` samples.

    A few steps of whole-number arithmetic, so that every engine draws alike.
    """
    x = np.add((draws * _DRAW + salt)[:, None], (picks * _PICK)[None, :])
    x = _mixed(x, np.empty_like(x))
    x *= n
    x >>= 31
    return x


def _means(samples: np.ndarray, draws: np.ndarray, salt: int) -> np.ndarray:
    """The mean of each of the numbered resamples."""
    wide = min(samples.size, DRAWN_AT_ONCE)
    tall = max(1, DRAWN_AT_ONCE // wide)
    out = np.zeros(draws.size)
    for i in range(0, draws.size, tall):
        own = draws[i : i + tall]
        for k in range(0, samples.size, wide):
            out[i : i + tall] += samples[places(own, np.arange(k, min(k + wide, samples.size)), samples.size, salt)].sum(1)
    return out / samples.size


def on_course(course: int, salt: int, n_bootstrap: int) -> np.ndarray:
    """The draws whose numbers are all ``course`` modulo _PICK: every _PICK-th, as _DRAW is 2 modulo _PICK and 129 is half of 1."""
    return np.arange((course - salt) * 129 % _PICK, n_bootstrap, _PICK)


def _means_on_course(sides: list[tuple[np.ndarray, np.ndarray, int]], course: int) -> list[np.ndarray]:
    """The means of the draws on one course, for each side's samples, draws and salt.

    A draw takes as many numbers of the course as it has picks, _DRAW further on than the draw before,
    and the sides differ in where they begin.  So each number is made once, looked up once for each
    side, and added to the sum between two ends of draws; these sums are then added up for each draw.
    """
    starts = [(draws * _DRAW + salt - course) // _PICK for _, draws, salt in sides]
    cuts = [np.unique(np.concatenate([own, own + samples.size])) for own, (samples, _, _) in zip(starts, sides)]
    # for each stretch between two cuts, whether any draw takes it
    taken = [np.searchsorted(own, at[:-1], "right") > np.searchsorted(own + samples.size, at[:-1], "right") for own, at, (samples, _, _) in zip(starts, cuts, sides)]
    sums = [np.zeros(at.size) for at in cuts]
    begin, end = min(int(at[0]) for at in cuts), max(int(at[-1]) for at in cuts)
    steps = np.arange(DRAWN_AT_ONCE) * _PICK
    x, spare, found = np.empty_like(steps), np.empty_like(steps), np.empty(DRAWN_AT_ONCE)
    for first in range(begin, end, DRAWN_AT_ONCE):
        last = min(first + DRAWN_AT_ONCE, end)
        wanted = []
        for side, at in enumerate(cuts):
            for k in range(max(int(np.searchsorted(at, first, "right")) - 1, 0), at.size - 1):
                if at[k] >= last:
                    break
                if taken[side][k]:
                    wanted.append((side, k, max(int(at[k]), first) - first, min(int(at[k + 1]), last) - first))
        if not wanted:
            continue
        np.add(steps, first * _PICK + course, out=x)
        _mixed(x, spare)
        for side, k, i, j in wanted:
            samples = sides[side][0]
            place = np.multiply(x[i:j], samples.size, out=spare[i:j])
            np.right_shift(place, 31, out=place)
            sums[side][k] += np.take(samples, place, out=found[i:j], mode="clip").sum()
    out = []
    for own, at, total, (samples, _, _) in zip(starts, cuts, sums, sides):
        ends = np.searchsorted(at, own), np.searchsorted(at, own + samples.size)
        out.append(np.array([total[i:j].sum() for i, j in zip(*ends)]) / samples.size)
    return out


def resampled(b: np.ndarray, c: np.ndarray, courses: range, n_bootstrap: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(draws, their means) on these courses for the baseline ``b`` and for ``c``; a course has other draws of the one than of the other."""
    sides = [(b, 2 * seed), (c, 2 * seed + 1)]
    drawn = [[on_course(k, salt, n_bootstrap) for k in courses] for _, salt in sides]
    if b.size + c.size <= _DRAW:  # courses would be walked for few picks of each draw
        return [(own, _means(samples, own, salt)) for (samples, salt), own in zip(sides, map(np.concatenate, drawn))]
    means: list[list[np.ndarray]] = [[], []]
    for n, course in enumerate(courses):
        own = [side for side in (0, 1) if drawn[side][n].size]
        told = _means_on_course([(sides[s][0], drawn[s][n], sides[s][1]) for s in own], course) if own else []
        for side, mean in zip(own, told):
            means[side].append(mean)
    return [(np.concatenate(own), np.concatenate([np.empty(0), *mean])) for own, mean in zip(drawn, means)]


_DRAWN = T.ArrayType(T.StructType([T.StructField("draw", T.LongType()), T.StructField("mean", T.DoubleType())]))


def _resamples(n_bootstrap: int, seed: int):
    """The draws on each row's courses and their means, beside its key."""

    def lists(draws: np.ndarray, means: np.ndarray) -> pa.Array:
        made = pa.StructArray.from_arrays([pa.array(draws, pa.int64()), pa.array(means, pa.float64())], names=["draw", "mean"])
        return pa.ListArray.from_arrays(pa.array([0, draws.size], pa.int32()), made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                b, c = (row.column(x).flatten().to_numpy(zero_copy_only=False).astype(float) for x in ("b", "c"))
                told = resampled(b, c, range(*(row.column(x)[0].as_py() for x in ("first", "last"))), n_bootstrap, seed)
                yield pa.RecordBatch.from_arrays([*(row.column(x) for x in KEY), *(lists(*own) for own in told)], names=[*KEY, "before", "now"])

    return run


#: Groups of keys whose work is added up before the sums of the groups are.
_GROUPS = 1024


def dealt(pairs: DataFrame, n_bootstrap: int, blocks: int) -> DataFrame:
    """The key of each pair of samples with its blocks, and in each the courses from ``first`` to before ``last``.

    The courses of all keys lie on one line, each as long as its work, that is cut into equal blocks.  So
    blocks have about the same work, and samples have a copy for each block on their stretch of the
    line: for all keys together less than as many more as there are blocks.
    """
    n = F.size("b").cast("long") + F.size("c")
    work = F.least(n, F.lit(_DRAW)) * n_bootstrap + n * _PICK  # about the numbers made and looked up
    own = pairs.select(*KEY, work.alias("work"), F.pmod(F.hash(*KEY), F.lit(_GROUPS)).alias("group"))
    sums = own.groupBy("group").agg(F.sum("work").alias("sum"))  # _GROUPS rows at most
    sums = sums.select("group", (F.sum("sum").over(Window.orderBy("group")) - F.col("sum")).alias("before"), F.sum("sum").over(Window.partitionBy()).alias("all"))
    inside = F.sum("work").over(Window.partitionBy("group").orderBy(*KEY)) - F.col("work")
    line = own.withColumn("inside", inside).join(F.broadcast(sums), "group").withColumn("at", F.col("before") + F.col("inside"))
    block_at = lambda x: F.least(F.floor(x / F.col("all") * blocks), F.lit(blocks - 1)).cast("int")
    line = line.withColumns({"low": block_at(F.col("at")), "high": block_at(F.col("at") + F.col("work"))}).withColumn("block", F.explode(F.sequence("low", "high")))
    # the first course that begins at the start of a block or after it
    course = lambda x: F.least(F.greatest(F.ceil((x / blocks * F.col("all") - F.col("at")) * _PICK / F.col("work")), F.lit(0)), F.lit(_PICK))
    first = F.when(F.col("block") == F.col("low"), 0).otherwise(course(F.col("block")))
    last = F.when(F.col("block") == F.col("high"), _PICK).otherwise(course(F.col("block") + 1))
    return line.select(*KEY, "block", first.cast("int").alias("first"), last.cast("int").alias("last")).where("first < last")


def bootstrap_intervals(baseline: DataFrame, current: DataFrame, n_bootstrap: int = 10_000, seed: int = 1) -> DataFrame:
    """Estimate and Bonferroni-corrected interval of each key common to two tables of samples.

    Keys with fewer than two samples on a side count as comparisons but get no interval.  The courses
    of the draws of all keys are dealt over tasks in blocks, with copies of the samples that a block needs.
    """
    ship(baseline.sparkSession)
    pairs = baseline.select(*KEY, F.col("samples").alias("b")).join(current.select(*KEY, F.col("samples").alias("c")), KEY)
    pairs = pairs.join(F.broadcast(pairs.agg(F.count("*").alias("comparisons"))))  # one row
    fit = pairs.where((F.size("b") >= 2) & (F.size("c") >= 2))
    n_blocks = max(BLOCKS, baseline.sparkSession.sparkContext.defaultParallelism * 4)
    blocks = fit.select(*KEY, F.col("b").cast("array<double>").alias("b"), F.col("c").cast("array<double>").alias("c")).join(dealt(fit, n_bootstrap, n_blocks), KEY)
    kinds = T.StructType([*(baseline.schema[k] for k in KEY), T.StructField("before", _DRAWN), T.StructField("now", _DRAWN)])
    told = blocks.repartitionById(n_blocks, F.col("block")).mapInArrow(_resamples(n_bootstrap, seed), kinds)
    by_draw = lambda x: F.sort_array(F.flatten(F.collect_list(x)))
    told = told.groupBy(*KEY).agg(by_draw("before").alias("before"), by_draw("now").alias("now"))  # n_bootstrap numbers a key
    slower = lambda b, c: F.when(b["mean"] != 0, (c["mean"] - b["mean"]) / b["mean"]).otherwise(0.0)
    spread = told.select(*KEY, F.sort_array(F.zip_with("before", "now", slower)).alias("draws"))
    alpha = F.lit(0.05) / F.greatest(F.col("comparisons"), F.lit(1))
    low = F.floor(F.lit(n_bootstrap) * (alpha / 2)).cast("int")
    high = F.least(F.floor(F.lit(n_bootstrap) * (1 - alpha / 2)), F.lit(n_bootstrap - 1)).cast("int")
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    estimate = F.coalesce(F.try_divide(mean(F.col("c")) - mean(F.col("b")), mean(F.col("b"))), F.lit(0.0))
    return pairs.join(spread, KEY, "left").select(
        *KEY, F.size("b").cast("long").alias("n_baseline"), F.size("c").cast("long").alias("n_current"), "comparisons", F.when(F.col("draws").isNotNull(), estimate).alias("estimate"), F.get("draws", low).alias("ci_low"), F.get("draws", high).alias("ci_high")
    )


def regression_report(traces: DataFrame, baseline: str, current: str, *, min_pairs: int = 20, threshold: float = 0.05, n_bootstrap: int = 10_000, seed: int = 1) -> DataFrame:
    """Status of each common key, and for regressions where the fast path was first lost."""
    told = bootstrap_intervals(samples(traces, baseline), samples(traces, current), n_bootstrap, seed)
    few = F.least("n_baseline", "n_current") < min_pairs
    status = F.when(few, "insufficient_data").when(F.col("ci_low") > threshold, "regression").otherwise("within_noise")
    lost = first_contiguity_loss(traces, current).select(*KEY, F.col("call_site").alias("lost_at"))
    out = told.withColumn("status", status).join(lost, KEY, "left")
    return out.withColumn("lost_at", F.when(F.col("status") == "regression", F.col("lost_at"))).orderBy(*KEY)


def shapes_for_remediation(traces: DataFrame, label: str) -> DataFrame:
    """The samples of a label beside the accelerated history of the same shapes."""
    return samples(traces, label).select(*KEY, "samples").join(contiguous_samples(traces), KEY, "left")
