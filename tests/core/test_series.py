from __future__ import annotations

import logging
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import ordering
from plumbline.operators.ordering import haloed, numbered
from plumbline.operators.prefix import prefix_sums
from plumbline.operators.series import Series, UnsupportedDTypeError
from plumbline.plans import regression
from plumbline.plans.remediation import NO_HISTORY, remediation
from plumbline.plans.selector import select_kernel
from plumbline.sources import prices
from plumbline.sources import traces as tr


def series(spark, values, kind="double", **more):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    return Series(df.withColumn("v", F.col("v").cast(kind)).repartition(3), "v", "i", **more)


def test_literals(spark):
    s = series(spark, [1, 2, 3, 4, 5])
    assert s.sum() == 15.0 and s.mean() == 3.0 and len(s) == 5 and s.shape == (5,) and s.dtype == "float64"
    assert series(spark, [1, 2, 3, 4]).project_affine(2, 10).to_numpy().tolist() == [12, 14, 16, 18]
    assert series(spark, [1, 5, 2, 8, -3, 4]).filter_gt(3).to_numpy().tolist() == [5, 8, 4]
    assert series(spark, [5, 5, 5]).filter_gt(5).to_numpy().size == 0
    assert series(spark, [1, float("nan"), 9]).filter_gt(0).to_numpy().tolist() == [1, 9]
    six = series(spark, [1, 2, 3, 4, 5, 6])
    assert six.rolling_sum(3).to_numpy().tolist() == [6, 9, 12, 15]
    assert six.rolling_sum(6).to_numpy().tolist() == [21]
    assert six.rolling_sum(10).to_numpy().size == six.rolling_sum(0).to_numpy().size == 0
    assert six.rolling_sum(1).to_numpy().tolist() == [1, 2, 3, 4, 5, 6]
    assert series(spark, [2, 4, 6, 8]).rolling_mean(2).to_numpy().tolist() == [3, 5, 7]
    assert six.every(2).to_numpy().tolist() == [1, 3, 5]
    assert six.running_sum(exclusive=True).to_numpy().tolist() == [0, 1, 3, 6, 10, 15]
    assert np.asarray(six, np.float32).dtype == np.float32
    with pytest.raises(ValueError):
        six.rolling_sum(-1)


def test_empty_and_types(spark):
    none = series(spark, [1.0]).filter_gt(5)
    assert none.sum() == 0.0
    with pytest.raises(ValueError):
        none.mean()
    with pytest.raises(UnsupportedDTypeError):
        Series(spark.range(3), "id", "id")
    f = series(spark, [0.1, 0.2], "float").project_affine(2.5, -1.5)
    assert f.dtype == "float32" and f.df.schema["v"].dataType.simpleString() == "float"
    assert f.to_numpy().tolist() == (np.array([0.1, 0.2], np.float32) * np.float32(2.5) + np.float32(-1.5)).tolist()


@pytest.mark.parametrize("strategy", ["window", "halo"])
def test_flagship_against_numpy(spark, strategy):
    p = prices.fixture(spark, 3000, 7)
    x = np.array([r[0] for r in p.orderBy("idx").select("price").collect()])
    d = np.diff(np.log(x))
    m = np.convolve(d, np.ones(20), "valid") / 20
    z = (m - m.mean()) / m.std()
    got = Series(p, "price", "idx", strategy=strategy).diff_log().rolling_mean(20).zscore().filter_gt(0.5).mean()
    assert np.isclose(got, z[z > 0.5].mean(), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize(("n", "window", "block"), [(500, 7, 50), (100, 20, 20), (33, 33, 40), (64, 1, 8)])
def test_halo_blocks(spark, n, window, block):
    rng = random.Random(n)
    values = [rng.uniform(-100, 100) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(5)
    out = haloed(df, ["i"], window, lambda w: {"s": F.sum("v").over(w.rowsBetween(1 - window, 0))}, block=block)
    got = [r["s"] for r in out.orderBy("i").collect()][window - 1 :]
    assert np.allclose(got, np.convolve(values, np.ones(window), "valid")) and out.count() == n
    assert [r["_row"] for r in numbered(df, ["i"]).orderBy("i").collect()] == list(range(n))
    sums = prefix_sums(df, "v", ["i"], [], block=block, single=0).orderBy("i").collect()
    assert np.allclose([r["v"] for r in sums], np.cumsum(values))


def test_selector(spark):
    cases = [("projection", 10**8, 8, 0.5, "scalar"), ("rolling", 10**8, 8, 0.5, "scalar"), ("reduction", 1000, 8, None, "avx2"), ("reduction", 10**7, 8, None, "mt_avx2"), ("reduction", 10**7, 1, None, "avx2"), ("filter", 1000, 8, 0.5, "avx2"), ("filter", 1000, 8, 0.05, "scalar"), ("filter", 1000, 8, 0.95, "scalar"), ("filter", 1000, 8, 0.3, "avx2"), ("filter", 1000, 8, 0.7, "avx2"), ("filter", 10**7, 8, 0.5, "mt_avx2"), ("filter", 10**7, 8, 0.02, "scalar"), ("filter", 1000, 8, -1.0, "avx2")]
    df = spark.createDataFrame(cases, "op string, n long, threads int, s double, want string")
    assert df.where(select_kernel(F.col("op"), F.col("n"), F.col("threads"), F.col("s")) != F.col("want")).count() == 0


def test_bootstrap():
    assert regression.bootstrap([2.0] * 5, [2.0] * 5, 200, seed=1) == (0.0, 0.0, 0.0)
    assert regression.bootstrap([1.0] * 5, [2.0] * 5, 200, seed=1) == (1.0, 1.0, 1.0)
    assert regression.bootstrap([0.0] * 5, [2.0] * 5, 200, seed=1) == (0.0, 0.0, 0.0)
    with pytest.raises(regression.InsufficientDataError):
        regression.bootstrap([1.0], [1.0, 2.0])
    assert [regression.bounds(10_000, regression.bonferroni(k)) for k in (1, 2, 4)] == [(250, 9750), (125, 9875), (62, 9937)]
    assert regression.evaluate([1.0] * 20, [1.05] * 20, threshold=0.05 + 1e-12)["status"] == "within_noise"
    assert regression.evaluate([1.0] * 20, [1.2] * 20)["status"] == "regression"
    assert regression.evaluate([1.0] * 3, [1.2] * 20)["status"] == "insufficient_data"


def test_remediation(spark):
    rows = [("filter", "float64", 1000, [5e7] * 10, [1000.0] * 10), ("filter", "float64", 10**8, [1e5] * 10, [99_000.0] * 10), ("filter", "float32", 10, [1.0, 2.0, 3.0, 4.0], None)]
    got = remediation(spark.createDataFrame(rows, "operator string, dtype string, row_count long, samples array<double>, accelerated array<double>"), 2.0).orderBy("row_count").collect()
    assert [r["recommend"] for r in got] == [False, True, False]
    assert got[0]["reason"] == NO_HISTORY and got[0]["savings_ns"] is None and got[1]["copy_cost_ns"] == 4000.0


def test_trace_store(spark, tmp_path, monkeypatch, caplog):
    store = tr.TraceStore(spark, str(tmp_path / "t"))
    assert store.traces().count() == 0 and tr.samples(store.traces(), "x").count() == 0
    with store.labelled("baseline:a"):
        s = series(spark, range(10), tracer=store)
        s.sum()
        s.mean()
    store.record("filter", 5000, "float32", contiguous=1, selected_kernel="mt_avx2", runtime_ns=4567.0, selectivity=0.35, available_cores=8)
    store.flush()
    rows = store.traces().orderBy("id").collect()
    assert [r["operator"] for r in rows] == ["reduction", "reduction", "filter"] and rows[0]["row_count"] == 10
    assert rows[0]["run_label"] == "baseline:a" and rows[0]["call_site"].startswith("test_series.py:") and rows[0]["window"] is None
    assert rows[2]["selectivity"] == 0.35 and '"machine"' in rows[2]["hardware_fingerprint"]
    assert tr.samples(store.traces(), "baseline:a").first()["n"] == 2
    spark.createDataFrame([(1, "filter")], "id long, operator string").write.parquet(str(tmp_path / "old"))
    assert tr.TraceStore(spark, str(tmp_path / "old")).traces().first()["call_site"] is None
    bad = tr.TraceStore(spark, "/proc/none/t")
    bad.record("filter", 1, "float32", contiguous=1, selected_kernel="scalar", runtime_ns=1.0)
    with caplog.at_level(logging.WARNING):
        bad.flush()
    assert "could not be written" in caplog.text
    monkeypatch.setenv(tr.OFF_ENV, "1")
    assert not tr.TraceStore(spark, str(tmp_path / "off")).enabled


def test_labels_are_folders(spark, tmp_path):
    """A label's reader reads its folder only; labels keep their type; old files beside the folders count."""
    store = tr.TraceStore(spark, str(tmp_path / "t"))
    one = dict(contiguous=1, selected_kernel="scalar", runtime_ns=1.0)
    for label in ("007", "baseline:a b/c", None):
        for _ in range(3):
            store.record("filter", 5, "float64", run_label=label, **one)
        store.flush()
    spark.createDataFrame([(1, "filter", "old")], "id long, operator string, run_label string").write.mode("append").parquet(str(tmp_path / "old"))
    (next((tmp_path / "old").glob("*.parquet"))).rename(tmp_path / "t" / "old.parquet")
    assert {r["run_label"]: r["count"] for r in store.traces().groupBy("run_label").count().collect()} == {"007": 3, "baseline:a b/c": 3, None: 3, "old": 1}
    plan = tr.labelled(store.traces(), "007")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_label" in plan
    store.record("filter", 5, "float64", run_label="007", **one)
    store.flush()
    store.compact("007")
    assert len(list((tmp_path / "t" / "labels" / "run_label=007").glob("*.parquet"))) == 1 and tr.labelled(store.traces(), "007").count() == 4
    assert store.traces().count() == 11


def test_numpy_reductions(spark):
    s = series(spark, [1, 2, 3, 4])
    assert np.sum(s) == np.sum(s, axis=0) == 10.0 and np.mean(s) == np.mean(s, axis=0) == 2.5 and np.std(s) == np.std([1, 2, 3, 4])
    assert np.std(s, ddof=1) == pytest.approx(np.std([1, 2, 3, 4], ddof=1)) and np.sum(s, dtype=np.float32).dtype == np.float32
    for bad in (dict(axis=1), dict(out=np.empty(()))):
        with pytest.raises(ValueError):
            np.sum(s, **bad)


def test_bad_logs_stay_in_place(spark):
    """What NumPy gives for logarithms of 0 and less, for a deviation of 0 and for windows over such values."""
    values = [1.0, 2.0, 0.0, 4.0, -1.0, 8.0, 16.0, 32.0]
    with np.errstate(all="ignore"):
        logs = np.log(np.array(values))
        want = np.diff(logs)
    s = series(spark, values)
    assert np.array_equal(s.log().to_numpy(), logs, equal_nan=True) and np.allclose(s.diff_log().to_numpy(), want, equal_nan=True)
    rolled = s.diff_log().rolling_sum(2).to_numpy()
    assert rolled.size == 6 and np.isclose(rolled[-1], 2 * np.log(2)) and np.isnan(rolled[2])
    assert np.isnan(series(spark, [5, 5, 5]).zscore().to_numpy()).tolist() == [True] * 3


def test_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "i long, v double")
    assert Series(df, "v", "i").sum() == 4.0
    with pytest.raises(Exception, match="v has nulls"):
        Series(df, "v", "i", nulls="reject").sum()
    halved = Series(df.na.drop(), "v", "i", nulls="reject").project_affine(1, 0).map(lambda x: F.when(x > 1, x))
    with pytest.raises(Exception, match="v has nulls"):
        halved.sum()


@pytest.mark.parametrize("strategy", ["window", "halo"])
def test_hot_keys_and_clashing_columns(spark, strategy, monkeypatch):
    """One key of nine tenths of the rows, a null key, and columns of the operators' own names."""
    from plumbline.operators import ordering

    monkeypatch.setattr(ordering, "BLOCK_ROWS", 64)
    rng = random.Random(5)
    rows = [(k, "hot" if k % 10 else [None, "a", "b"][k // 10 % 3], rng.uniform(1, 9), k, "x", 1.5) for k in range(1000)]
    df = spark.createDataFrame(rows, "i long, g string, v double, _row long, _out string, _last double").repartition(4)
    want = {}
    for k, g, v, *_ in rows:
        want.setdefault(g, []).append((k, v))
    s = Series(df, "v", "i", "g", strategy=strategy)
    got = {(r["g"], r["i"]): r for r in s.rolling_sum(7).df.collect()}
    assert {(g, k): pytest.approx(sum(x for _, x in own[n - 6 : n + 1])) for g, own in want.items() for n, (k, _) in enumerate(own) if n >= 6} == {k: r["v"] for k, r in got.items()}
    assert all(r["_row"] == r["i"] and r["_out"] == "x" for r in got.values())
    assert {(r["g"], r["i"]): r["v"] for r in s.diff().df.collect()} == {(g, b[0]): pytest.approx(b[1] - a[1]) for g, own in want.items() for a, b in zip(own, own[1:])}
    sums = prefix_sums(df.select("i", "g", "v"), "v", ["i"], ["g"], block=50, single=0 if strategy == "halo" else 10**6).collect()
    total = {(g, k): sum(x for _, x in own[: n + 1]) for g, own in want.items() for n, (k, _) in enumerate(own)}
    assert {(r["g"], r["i"]): r["v"] for r in sums} == {k: pytest.approx(v) for k, v in total.items()}


def test_wide_windows_are_not_summed_anew(spark):
    """The plan of a wide window has no moving frame of its width, nor has one that is longer than the series."""
    s = series(spark, range(3000))
    for wide in (1500, 3000, 3001):
        for rolled in (s.rolling_sum(wide), s.rolling_mean(wide), s.rolling_std(wide), s.rolling_var(wide)):
            plan = rolled.df._jdf.queryExecution().optimizedPlan().toString()
            assert max([int(k) for k in re.findall(r"RowFrame, -(\d+)", plan)], default=0) <= ordering.FRAME_ROWS
    assert s.rolling_sum(1500).to_numpy().tolist() == [1500 * (k - 749.5) for k in range(1499, 3000)]
    assert s.rolling_sum(3001).to_numpy().size == 0
    rejecting = Series(s.df.withColumn("v", F.when(F.col("i") != 7, F.col("v"))), "v", "i", nulls="reject")
    with pytest.raises(Exception, match="v has nulls"):
        rejecting.rolling_sum(3001).df.collect()


@pytest.mark.parametrize("strategy", ["window", "halo"])
@pytest.mark.parametrize("window", [5, 65, 130, 898])
def test_wide_windows(spark, strategy, window, monkeypatch):
    """Frames of parts against NumPy: one key of nine tenths of the rows, a null key, columns of the parts' names."""
    monkeypatch.setattr(ordering, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ordering, "FRAME_ROWS", 4)
    rng = random.Random(6)
    rows = [(k, "hot" if k % 10 else [None, "a", "b"][k // 10 % 3], 1e6 + rng.uniform(1, 9), k, "x", 1.5) for k in range(1000)]
    df = spark.createDataFrame(rows, "i long, g string, v double, _row long, held string, block double").repartition(4)
    own = {}
    for k, g, v, *_ in rows:
        own.setdefault(g, []).append((k, v))
    s = Series(df, "v", "i", "g", strategy=strategy)
    for name, make in (("sum", np.sum), ("mean", np.mean), ("std", np.std), ("var", np.var)):
        got = getattr(s, f"rolling_{name}")(window).df.collect()
        want = {(g, xs[n][0]): pytest.approx(make([x for _, x in xs[n - window + 1 : n + 1]]), rel=1e-9) for g, xs in own.items() for n in range(window - 1, len(xs))}
        assert {(r["g"], r["i"]): r["v"] for r in got} == want and len(got) == len(want)
        assert all(r["_row"] == r["i"] and r["held"] == "x" and r["block"] == 1.5 for r in got)


def test_wide_windows_keep_infinities(spark, monkeypatch):
    monkeypatch.setattr(ordering, "FRAME_ROWS", 2)
    values = [1.0, 2.0, float("inf"), 4.0, 5.0, 6.0, float("nan"), 8.0, 9.0, 10.0, 11.0]
    want = [float(sum(values[k - 3 : k + 1])) for k in range(3, len(values))]
    assert series(spark, values).rolling_sum(4).to_numpy().tolist() == pytest.approx(want, nan_ok=True)
    assert series(spark, values, "float").rolling_mean(4).to_numpy().tolist() == pytest.approx([x / 4 for x in want], nan_ok=True)


def test_one_count_for_a_chain(spark, monkeypatch):
    s = series(spark, range(1, 50))
    counted = []
    monkeypatch.setattr(type(s), "most", lambda own, real=type(s).most: counted.append(len(own._most)) or real(own))
    s.diff_log().rolling_mean(3).diff().zscore()
    assert counted == [0, 1, 1]


def test_upper_medians(spark):
    from plumbline.functions.numeric import upper_median

    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 3.0], [4.0, 1.0, 3.0, 2.0], [2.0, 2.0, 7.0, 7.0, 1.0, 9.0]):
        assert series(spark, values).df.agg(upper_median("v")).first()[0] == sorted(values)[len(values) // 2]


def test_distributed_bootstrap(spark):
    """The blocks' draws against one loop over all draws and picks."""
    rng = random.Random(4)
    b, c = [rng.uniform(90, 110) for _ in range(23)], [rng.uniform(95, 120) for _ in range(31)]
    side = lambda xs: spark.createDataFrame([("filter", "float64", 10, xs), ("filter", "float32", 10, [1.0])], "operator string, dtype string, row_count long, samples array<double>")

    def place(i, k, n, salt):
        x = (i * 65537 + k * 257 + salt) % 2147483647
        for factor, shift in ((48271, 11), (69621, 12345)):
            x = (x * factor + shift) % 2147483647
            x = (x * x + shift) % 2147483647
        return x * n >> 31

    def mean(xs, i, salt):
        return sum(xs[place(i, k, len(xs), salt)] for k in range(len(xs))) / len(xs)

    draws = sorted((mean(c, i, 7) - mean(b, i, 6)) / mean(b, i, 6) for i in range(1100))
    got = {r["dtype"]: r for r in regression.bootstrap_intervals(side(b), side(c), 1100, seed=3).collect()}
    low, high = regression.bounds(1100, regression.bonferroni(2))
    assert (got["float64"]["ci_low"], got["float64"]["ci_high"]) == (pytest.approx(draws[low]), pytest.approx(draws[high]))
    assert got["float32"]["ci_low"] is None and got["float32"]["comparisons"] == 2
    usual = regression.bootstrap(b, c, 4000, regression.bonferroni(2), seed=1)
    assert got["float64"]["ci_low"] == pytest.approx(usual[1], abs=0.02) and got["float64"]["estimate"] == pytest.approx(usual[0])


def test_mixed_numbers():
    """The steps without remainders against Python's numbers, at the ends of the range and where the last remainder is 0, 1 or 2."""
    p = 2147483647

    def mixed(x):
        for factor, shift in ((48271, 11), (69621, 12345)):
            x = (x * factor + shift) % p
            x = (x * x + shift) % p
        return x

    def before(x):
        """The numbers that the two rounds turn into ``x``."""
        found = [x]
        for factor, shift in ((69621, 12345), (48271, 11)):
            halves = [(y, pow((y - shift) % p, (p + 1) // 4, p)) for y in found]
            roots = [r for y, half in halves for r in (half, p - half) if (r * r + shift - y) % p == 0]
            found = [(r - shift) * pow(factor, -1, p) % p for r in roots]
        return found

    rng = random.Random(8)
    ends = [x for last in range(40) for x in before(last)]
    assert ends and min(mixed(x) for x in ends) <= 2
    numbers = [0, 1, p - 1, p, p + 1, 2 * p, 2**31, 2**61, 2**62 - 1, *ends, *(x + p for x in ends), *(rng.randrange(2**62) for _ in range(5000))]
    x = np.array(numbers)
    assert regression._mixed(x, np.empty_like(x)).tolist() == [mixed(k) for k in numbers]


@pytest.mark.parametrize("sizes", [(70_000, 40_000), (3, 90_000), (150_000, 140_001), (20_000, 30_000)])
def test_draws_on_one_course(sizes, monkeypatch):
    """Draws that share a course against each draw by itself, and without a number for each pick."""
    rng = np.random.default_rng(9)
    b, c = (rng.uniform(1, 500, n) for n in sizes)
    made = []
    monkeypatch.setattr(regression, "_mixed", lambda x, spare, real=regression._mixed: made.append(x.size) or real(x, spare))
    told = regression.resampled(b, c, range(5, 257, 100), 3000, 3)
    if sum(sizes) > 65537:
        assert sum(made) < 0.8 * sum(own.size * x.size for (own, _), x in zip(told, (b, c)))
    for (own, means), x, salt in zip(told, (b, c), (6, 7)):
        assert means == pytest.approx(regression._means(x, own, salt), rel=1e-12)
    for salt in (6, 7):
        assert sorted(d for k in range(257) for d in regression.on_course(k, salt, 3000)) == list(range(3000))


def test_distributed_courses(spark):
    """Keys with samples enough to share courses, and a few draws only."""
    rng = np.random.default_rng(10)
    b, c = rng.uniform(90, 110, 50_000), rng.uniform(95, 120, 30_000)
    side = lambda xs: spark.createDataFrame([("filter", "float64", 10, xs.tolist())], "operator string, dtype string, row_count long, samples array<double>")
    draws = np.arange(300)
    before, now = regression._means(b, draws, 2), regression._means(c, draws, 3)
    got = regression.bootstrap_intervals(side(b), side(c), 300).first()
    want = np.sort((now - before) / before)
    low, high = regression.bounds(300, regression.bonferroni(1))
    assert (got["ci_low"], got["ci_high"]) == (pytest.approx(want[low], rel=1e-9), pytest.approx(want[high], rel=1e-9))
    # a baseline of zeros, and one with NaN
    zeros = regression.bootstrap_intervals(side(np.zeros(40)), side(c[:50]), 300).first()
    assert zeros["ci_low"] == zeros["ci_high"] == zeros["estimate"] == 0.0
    assert np.isnan(regression.bootstrap_intervals(side(np.array([np.nan] * 4)), side(c[:50]), 300).first()["ci_low"])


def test_report_of_large_shapes(spark):
    """A slower shape of many samples and a steady one; each task has one block of draws of every shape."""
    ids = spark.range(140_000).select("id", (F.col("id") % 2 == 0).alias("before"), F.when(F.col("id") % 20 > 1, "filter").otherwise("rolling").alias("operator"))
    slower = F.when((F.col("operator") == "filter") & ~F.col("before"), 1.2).otherwise(1.0)
    made = ids.select(
        "id", "operator", F.lit(10).alias("row_count"), F.lit("float64").alias("dtype"), (F.col("id") % 3).alias("contiguous"), F.lit("s").alias("selected_kernel"), (slower * (100 + F.hash("id") % 7)).alias("runtime_ns"),
        F.col("id").cast("double").alias("timestamp"), F.when(F.col("before"), "a").otherwise("b").alias("run_label"), F.concat(F.lit("x.py:"), "id").alias("call_site"),
    )
    report = regression.regression_report(tr.migrated(made), "a", "b", n_bootstrap=300)
    assert "direct_shuffle_partition_id(block" in report._jdf.queryExecution().optimizedPlan().toString()
    got = {r["operator"]: (r["status"], r["lost_at"], r["n_baseline"]) for r in report.collect()}
    assert got == {"filter": ("regression", "x.py:3", 63_000), "rolling": ("within_noise", None, 7_000)}


def _sized(spark, sizes):
    """Keys and both sides' samples; sizes are of each side."""
    keys = spark.createDataFrame([("filter", "float64", k, *n) for k, n in enumerate(sizes)], "operator string, dtype string, row_count long, nb int, nc int")
    value = lambda salt: lambda i: F.pmod(F.hash(i, "row_count", F.lit(salt)), F.lit(1000)) + 1.0
    return keys.select(*tr.KEY, F.transform(F.sequence(F.lit(1), "nb"), value(0)).alias("b"), F.transform(F.sequence(F.lit(1), "nc"), value(1)).alias("c"))


@pytest.mark.parametrize("sizes", [[(300_000, 200_000), *[(2, 3)] * 400], [(40_000, 30_000)] * 3 + [(20, 9_000)] * 21, [(2, 2)]])
def test_courses_are_dealt_whole(spark, sizes):
    """Each course of each key lies in one block, blocks have equal work, and few keys lie in more than one."""
    rows = regression.dealt(_sized(spark, sizes), 10_000, 48).collect()
    assert len(rows) < len(sizes) + 48
    courses, work = {}, [0] * 48
    for r in rows:
        n = sum(sizes[r["row_count"]])
        courses.setdefault(r["row_count"], []).extend(range(r["first"], r["last"]))
        work[r["block"]] += (min(n, 65537) * 10_000 + n * 257) * (r["last"] - r["first"])
    assert sorted(courses) == list(range(len(sizes))) and all(sorted(k) == list(range(257)) for k in courses.values())
    assert max(work) <= sum(work) / 48 + max(min(sum(n), 65537) * 10_000 + sum(n) * 257 for n in sizes)  # the last course may run over


def test_few_copies_of_samples(spark, monkeypatch):
    """The resampling takes about a copy of each key's samples, not one for each block, and draws as before."""
    copies = spark.sparkContext.accumulator(0)

    def counted(*args, real=regression._resamples):
        run = real(*args)

        def count(batches):
            for batch in batches:
                copies.add(batch.num_rows)
                yield from run([batch])

        return count

    monkeypatch.setattr(regression, "_resamples", counted)
    sizes = [(3_000, 2_000), (1, 50), *[(30, 40)] * 60]
    both = _sized(spark, sizes).cache()
    told = {r["row_count"]: r for r in regression.bootstrap_intervals(both.select(*tr.KEY, F.col("b").alias("samples")), both.select(*tr.KEY, F.col("c").alias("samples")), 300).collect()}
    assert 61 <= copies.value < 61 + 48
    low, high = regression.bounds(300, regression.bonferroni(62))
    for r in both.collect():
        b, c = np.array(r["b"]), np.array(r["c"])
        if b.size < 2:
            assert told[r["row_count"]]["ci_low"] is None
            continue
        before, now = regression._means(b, np.arange(300), 2), regression._means(c, np.arange(300), 3)
        want = np.sort((now - before) / before)
        got = told[r["row_count"]]
        assert (got["ci_low"], got["ci_high"]) == (pytest.approx(want[low], rel=1e-9), pytest.approx(want[high], rel=1e-9))
    both.unpersist()


def test_cleared_tables(spark):
    from plumbline.plans.materialize import clear, guarded, scratch, table

    table(spark.range(3).toDF("x"), "t")
    folder = f"{scratch(spark)}/plumbline/{spark.sparkContext.applicationId}".removeprefix("file://")
    import os

    assert os.path.isdir(folder)
    clear(spark)
    assert not os.path.exists(folder)
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(guarded(spark.range(9).toDF("x"))) and not hinted(guarded(spark.range(9).toDF("x"), limit=8)) and not hinted(guarded(spark.range(9).toDF("x"), size=64))


def test_hardware_confound(spark):
    def warn(b, c):
        rows = [(h, "b") for h in b] + [(h, "c") for h in c]
        return tr.hardware_confound(spark.createDataFrame(rows, "hardware_fingerprint string, run_label string"), "b", "c").first()["warning"]

    assert warn("A", "A") == "" and warn("", "A") == "" and warn("A", "") == ""
    assert "different" in warn("A", "B") and "\n" not in warn("A", "B")
    assert "different" in warn("A", "AB") and "more than one" in warn("A", "AB")


def test_profile_mode(spark, tmp_path):
    store = tr.TraceStore(spark, str(tmp_path / "p"), profile=True)
    series(spark, range(10), tracer=store).filter_gt(4.0).rolling_mean(2)
    store.flush()
    rows = {r["operator"]: r for r in store.traces().collect()}
    assert rows["filter"]["selectivity"] == 0.5 and rows["rolling"]["window"] == 2


def test_stream(spark, tmp_path):
    from plumbline.streaming.ingest import read_stream, runtimes_by_window, transformed

    store = tr.TraceStore(spark, str(tmp_path / "s"))
    for k in range(4):
        store.record("filter", 10, "float64", contiguous=1, selected_kernel="scalar", runtime_ns=100.0 * k)
    store.flush()
    means = runtimes_by_window(transformed(read_stream(spark, store.path), 2.0, 0.0, 100.0))
    q = means.writeStream.format("memory").queryName("runtimes").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120) is not False
    assert spark.table("runtimes").select("mean_ns", "calls").first()[:] == (400.0, 3)


def test_generated_prices(spark):
    rows = prices.generate(spark, 500, 3).orderBy("idx").collect()
    assert len(rows) == 500 and all(r["price"] > 0 for r in rows)


def test_sweep(spark, tmp_path):
    from plumbline.plans.characterize import sweep

    sweep(spark, (200,), selectivities=(0.5,), windows=(5,), repeats=2).coalesce(1).write.csv(str(tmp_path / "sweep"), header=True)
    rows = spark.read.csv(str(tmp_path / "sweep"), header=True).collect()
    assert len(rows) == 8 and {r["operation"] for r in rows} == {"reduction", "projection", "filter", "rolling"}
