"""The registered queries of the series engine and of the performance history, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import numeric
from plumbline.operators.ordering import haloed, numbered
from plumbline.operators.prefix import prefix_sums
from plumbline.operators.series import Series
from plumbline.plans.regression import bootstrap_intervals, regression_report, shapes_for_remediation
from plumbline.plans.remediation import copy_cost, remediation
from plumbline.plans.selector import select_kernel, selected
from plumbline.sources import traces as tr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BASELINE, CURRENT = "baseline:v1", "check:v1:1"
BOOTSTRAPS = 10_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> Series:
    return Series(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


def events(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "value", *more)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")


_FLAGSHIP = """
WITH d AS (SELECT o_orderkey, ln(o_totalprice) - ln(lag(o_totalprice) OVER (ORDER BY o_orderkey)) AS x, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders),
m AS (SELECT avg(x) OVER (ORDER BY o_orderkey ROWS 19 PRECEDING) AS x, row_number() OVER (ORDER BY o_orderkey) AS r FROM d WHERE r > 1),
v AS (SELECT x FROM m WHERE r >= 20),
z AS (SELECT (x - (SELECT avg(x) FROM v)) / nullif((SELECT stddev_pop(x) FROM v), 0) AS z FROM v)
SELECT round(coalesce(avg(z), 0), 9) AS factor, count(*) AS n FROM z WHERE z > 0.5 AND NOT isnan(z)"""


@query(_FLAGSHIP)
def pipeline_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = prices(spark, sf_dir).diff_log().rolling_mean(20).zscore().filter_gt(0.5)
    return signal.df.agg(F.round(F.coalesce(F.avg(signal.x), F.lit(0.0)), 9).alias("factor"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * 2.5 - 1.5, 6) AS l_extendedprice FROM lineitem")
def project_affine_f64(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Series(items(spark, sf_dir), "l_extendedprice", ["l_orderkey", "l_linenumber"]).project_affine(2.5, -1.5)
    return out.df.withColumn("l_extendedprice", F.round(out.x, 6))


@query("SELECT event_id, CAST(CAST(value AS FLOAT) * CAST(2.5 AS FLOAT) + CAST(-1.5 AS FLOAT) AS DOUBLE) AS value FROM events")
def project_affine_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Series(events(spark, sf_dir).withColumn("value", F.col("value").cast("float")), "value", "event_id").project_affine(2.5, -1.5)
    return out.df.withColumn("value", out.x.cast("double"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000 AND NOT isnan(l_extendedprice)")
def filter_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Series(items(spark, sf_dir), "l_extendedprice", ["l_orderkey", "l_linenumber"]).filter_gt(50_000.0).df


@query("SELECT count(*) AS n, min(value) AS least FROM events WHERE value > (SELECT median(value) FROM events) AND NOT isnan(value)")
def filter_gt_strict_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    passed = Series(df, "value", "event_id").filter_gt(df.agg(F.median("value")).first()[0])
    return passed.df.agg(F.count("*").alias("n"), F.min("value").alias("least"))


@query("SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value FROM events) WHERE value > 100 AND NOT isnan(value)")
def filter_gt_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return Series(df, "value", "event_id").filter_gt(100.0).df


@query("SELECT event_type, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END), 9) AS selectivity FROM events GROUP BY event_type")
def filter_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "event_type").groupBy("event_type").agg(F.round(numeric.selectivity(numeric.above(F.col("value"), 100.0)), 9).alias("selectivity"))


@query("SELECT round(coalesce(sum(l_extendedprice), 0), 2) AS sum FROM lineitem")
def reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Series(items(spark, sf_dir), "l_extendedprice", ["l_orderkey", "l_linenumber"]).sum_df().select(F.round("sum", 2).alias("sum"))


@query("SELECT coalesce(sum(l_extendedprice), 0.0::DOUBLE) AS sum FROM lineitem WHERE l_extendedprice < 0")
def reduce_sum_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Series(items(spark, sf_dir).where("l_extendedprice < 0"), "l_extendedprice", ["l_orderkey", "l_linenumber"]).sum_df()


@query("SELECT round(avg(l_extendedprice), 6) AS mean FROM lineitem")
def reduce_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Series(items(spark, sf_dir), "l_extendedprice", ["l_orderkey", "l_linenumber"]).mean_df().select(F.round("mean", 6).alias("mean"))


@query("SELECT round(stddev_pop(l_extendedprice), 6) AS std FROM lineitem")
def reduce_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Series(items(spark, sf_dir), "l_extendedprice", ["l_orderkey", "l_linenumber"]).std()
    return spark.createDataFrame([(found,)], "std double").select(F.round("std", 6).alias("std"))


@query("SELECT event_type, user_id, round(coalesce(sum(value), 0), 6) AS sum FROM events GROUP BY event_type, user_id")
def reduce_sum_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Series(events(spark, sf_dir, "event_type", "user_id"), "value", "event_id").agg_by("event_type", "user_id").withColumn("sum", F.round("sum", 6))


def _rolling_sql(kind: str, width: int, table: str = "events", by: str = "", order: str = "event_id", value: str = "value", digits: int = 6) -> str:
    over = f"OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY {order}"
    return f"SELECT {by + ', ' if by else ''}{order}, round(x, {digits}) AS {value} FROM (SELECT *, {kind}({value}) {over} ROWS {width - 1} PRECEDING) AS x, row_number() {over}) AS r FROM {table}) WHERE r >= {width}"


def _rounded(s: Series, *keys: str) -> DataFrame:
    return s.df.select(*keys, F.round(s.x, 6).alias(s.value))


@query(_rolling_sql("sum", 20))
def rolling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Series(events(spark, sf_dir), "value", "event_id").rolling_sum(20), "event_id")


@query(_rolling_sql("avg", 20))
def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Series(events(spark, sf_dir), "value", "event_id").rolling_mean(20), "event_id")


@query("SELECT event_id, value FROM events WHERE false")
def rolling_window_gt_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Series(events(spark, sf_dir), "value", "event_id")
    return s.rolling_sum(len(s) + 1).df


@query(_rolling_sql("sum", 20))
def rolling_sum_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Series(events(spark, sf_dir), "value", "event_id", strategy="halo").rolling_sum(20), "event_id")


@query(_rolling_sql("avg", 5, by="user_id"))
def rolling_mean_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Series(events(spark, sf_dir, "user_id"), "value", "event_id", "user_id").rolling_mean(5), "user_id", "event_id")


@query(_rolling_sql("avg", 5, by="user_id"))
def rolling_mean_by_user_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Series(events(spark, sf_dir, "user_id"), "value", "event_id", "user_id", strategy="halo").rolling_mean(5), "user_id", "event_id")


@query(_rolling_sql("stddev_pop", 10))
def rolling_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Series(events(spark, sf_dir), "value", "event_id").rolling_std(10), "event_id")


@query(_rolling_sql("var_pop", 10, digits=4))
def rolling_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Series(events(spark, sf_dir), "value", "event_id").rolling_var(10)
    return out.df.select("event_id", F.round("value", 4).alias("value"))


@query("SELECT event_id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS value FROM (SELECT *, sum(CAST(CAST(value AS FLOAT) AS DOUBLE)) OVER (ORDER BY event_id ROWS 4 PRECEDING) AS x, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r >= 5")
def rolling_sum_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Series(events(spark, sf_dir).withColumn("value", F.col("value").cast("float")), "value", "event_id").rolling_sum(5)
    return out.df.withColumn("value", out.x.cast("double"))


@query("SELECT event_id, round(value - p, 6) AS value FROM (SELECT *, lag(value) OVER (ORDER BY event_id) AS p, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r > 1")
def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Series(events(spark, sf_dir), "value", "event_id").diff(), "event_id")


@query("SELECT o_orderkey, round(ln(o_totalprice) - ln(p), 6) AS o_totalprice FROM (SELECT *, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS p, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r > 1")
def diff_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(prices(spark, sf_dir).diff_log(), "o_orderkey")


@query(
    """WITH l AS (SELECT event_id, CASE WHEN x > 0 THEN ln(x) WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS y FROM (SELECT event_id, CASE WHEN event_id % 500 = 7 THEN 0 WHEN event_id % 700 = 9 THEN -value ELSE value END AS x FROM events)),
 d AS (SELECT event_id, y - lag(y) OVER (ORDER BY event_id) AS d, row_number() OVER (ORDER BY event_id) AS r FROM l)
 SELECT event_id, CASE WHEN isfinite(d) THEN round(d, 6) END AS value, isinf(d) AS infinite, isnan(d) AS undefined FROM d WHERE r > 1"""
)
def diff_log_of_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("event_id") % 500 == 7, 0.0).when(F.col("event_id") % 700 == 9, -F.col("value")).otherwise(F.col("value"))
    out = Series(events(spark, sf_dir).withColumn("value", bad), "value", "event_id").diff_log()
    infinite, undefined = F.abs(out.x) == float("inf"), F.isnan(out.x)
    return out.df.select("event_id", F.when(~infinite & ~undefined, F.round(out.x, 6)).alias("value"), infinite.alias("infinite"), undefined.alias("undefined"))


@query("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / nullif((SELECT stddev_pop(o_totalprice) FROM orders), 0), 6) AS o_totalprice FROM orders")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(prices(spark, sf_dir).zscore(), "o_orderkey")


@query("SELECT p_partkey, p_brand, round((p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand)) / nullif(stddev_pop(p_retailprice) OVER (PARTITION BY p_brand), 0), 6) AS p_retailprice FROM part")
def zscore_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return _rounded(Series(df, "p_retailprice", "p_partkey", "p_brand").zscore(), "p_partkey", "p_brand")


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) - value, 4) AS value FROM events")
def prefix_sum_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_sums(events(spark, sf_dir), "value", ["event_id"], [], exclusive=True, block=3000, single=0).select("event_id", F.round("value", 4).alias("value"))


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) WHERE r % 2 = 0")
def strided_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Series(events(spark, sf_dir), "value", "event_id").every(2).df


@query("SELECT event_id, round(sqrt(value), 6) AS value FROM events")
def ufunc_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Series(events(spark, sf_dir), "value", "event_id").map(F.sqrt), "event_id")


@query("SELECT e.event_id, round(e.value + f.value, 6) AS value FROM events e JOIN (SELECT event_id, value * 10 AS value FROM events WHERE event_id % 2 = 0) f USING (event_id)")
def binary_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Series(events(spark, sf_dir), "value", "event_id")
    other = Series(events(spark, sf_dir).where("event_id % 2 = 0"), "value", "event_id").project_affine(10.0, 0.0)
    return _rounded(s.zip_with(other, lambda x, y: x + y), "event_id")


@query(
    """WITH a AS (SELECT event_id, value * 2 + 1 AS x FROM events), f AS (SELECT event_id, x FROM a WHERE x > 200 AND NOT isnan(x)),
    m AS (SELECT avg(x) OVER (ORDER BY event_id ROWS 9 PRECEDING) AS x, row_number() OVER (ORDER BY event_id) AS r FROM f)
    SELECT round(coalesce(sum(x), 0), 4) AS sum FROM m WHERE r >= 10"""
)
def chain_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Series(events(spark, sf_dir), "value", "event_id").project_affine(2.0, 1.0).filter_gt(200.0).rolling_mean(10)
    return chain.sum_df().select(F.round("sum", 4).alias("sum"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS _row FROM events")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(events(spark, sf_dir), ["event_id"]).select("event_id", F.col("_row").cast("long").alias("_row"))


@query("SELECT event_id, round(coalesce(lag(value) OVER (ORDER BY event_id), 0), 6) AS before FROM events")
def lag_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return haloed(events(spark, sf_dir), ["event_id"], 2, lambda w: {"before": F.lag("value").over(w)}, block=700).select("event_id", F.round(F.coalesce("before", F.lit(0.0)), 6).alias("before"))



@query("SELECT vec_id, i, CAST(CAST(embedding[i] AS FLOAT) * CAST(2 AS FLOAT) + CAST(1 AS FLOAT) AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def array_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(numeric.array_affine(F.col("embedding"), 2.0, 1.0)).alias("i", "x"))
    return out.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.col("x").cast("double").alias("x"))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0.1 AND NOT isnan(x))) AS BIGINT) AS n, round(coalesce(list_sum(list_transform(list_filter(embedding, lambda x: x > 0.1 AND NOT isnan(x)), lambda x: CAST(x AS DOUBLE))), 0), 6) AS sum FROM embeddings")
def array_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = numeric.array_above(F.col("embedding"), 0.1)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.size(kept).cast("long").alias("n"), F.round(numeric.array_sum(kept), 6).alias("sum"))


@query("SELECT vec_id, round(coalesce(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 0), 6) AS sum FROM embeddings")
def array_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(numeric.array_sum(F.col("embedding")), 6).alias("sum"))


@query("SELECT vec_id, i, CAST(CAST(list_sum(list_transform(embedding[i:i+7], lambda x: CAST(x AS DOUBLE))) AS FLOAT) AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) - 6)) AS i FROM embeddings)")
def array_rolling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(numeric.array_rolling_sum(F.col("embedding"), 8)).alias("i", "x"))
    return out.select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.col("x").cast("double").alias("x"))


_TRACES = f"""WITH traces AS (SELECT event_id AS id,
 CASE event_type WHEN 'click' THEN 'projection' WHEN 'purchase' THEN 'reduction' WHEN 'signup' THEN 'rolling' ELSE 'filter' END AS operator,
 (user_id % 3 + 1) * 1000 AS row_count, CASE WHEN user_id % 2 = 0 THEN 'float64' ELSE 'float32' END AS dtype,
 CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS contiguous,
 CASE WHEN event_type IN ('view', 'error') THEN least(value / 500, 1) END AS selectivity,
 CASE WHEN event_type = 'error' THEN 'numpy_fallback' WHEN event_type = 'view' THEN 'avx2' WHEN event_type = 'purchase' THEN 'mt_avx2' ELSE 'scalar' END AS selected_kernel,
 value * 1000 AS runtime_ns, CASE WHEN event_id % 10 = 0 THEN 'B' ELSE 'A' END AS hardware_fingerprint,
 epoch_us(ts) / 1000000.0::DOUBLE AS timestamp, CASE WHEN event_id % 2 = 0 THEN '{BASELINE}' ELSE '{CURRENT}' END AS run_label,
 CASE WHEN user_id % 11 <> 0 THEN 'script.py:' || (user_id % 7) END AS call_site FROM events)
"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace table derived from ``events``."""
    kind, user = F.col("event_type"), F.col("user_id")
    e = _table(spark, sf_dir, "events")
    made = e.select(
        F.col("event_id").alias("id"),
        F.when(kind == "click", "projection").when(kind == "purchase", "reduction").when(kind == "signup", "rolling").otherwise("filter").alias("operator"),
        ((user % 3 + 1) * 1000).alias("row_count"),
        F.when(user % 2 == 0, "float64").otherwise("float32").alias("dtype"),
        F.when(kind == "error", 0).otherwise(1).alias("contiguous"),
        F.when(kind.isin("view", "error"), F.least(F.col("value") / 500, F.lit(1.0))).alias("selectivity"),
        F.when(kind == "signup", F.lit(20)).alias("window"),
        F.lit(8).alias("available_cores"),
        F.when(kind == "error", "numpy_fallback").when(kind == "view", "avx2").when(kind == "purchase", "mt_avx2").otherwise("scalar").alias("selected_kernel"),
        (F.col("value") * 1000).alias("runtime_ns"),
        F.when(F.col("event_id") % 10 == 0, "B").otherwise("A").alias("hardware_fingerprint"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        F.when(F.col("event_id") % 2 == 0, BASELINE).otherwise(CURRENT).alias("run_label"),
        F.when(user % 11 != 0, F.concat(F.lit("script.py:"), (user % 7).cast("string"))).alias("call_site"),
    )
    return tr.migrated(made)


_KEYS = "operator, dtype, row_count"


@query(_TRACES + f"SELECT {_KEYS}, count(*) AS n, round(sum(runtime_ns), 3) AS total_ns, min(runtime_ns) AS least_ns FROM traces WHERE run_label = '{BASELINE}' GROUP BY {_KEYS}")
def trace_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tr.samples(history(spark, sf_dir), BASELINE)
    return own.select(*tr.KEY, "n", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 3).alias("total_ns"), F.get("samples", F.lit(0)).alias("least_ns"))


@query(_TRACES + f"SELECT DISTINCT hardware_fingerprint FROM traces WHERE run_label = '{CURRENT}'")
def trace_distinct_hw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.fingerprints(history(spark, sf_dir), CURRENT)


@query(
    _TRACES
    + f"""SELECT count(DISTINCT CASE WHEN run_label = '{BASELINE}' THEN hardware_fingerprint END) AS n_baseline, count(DISTINCT CASE WHEN run_label = '{CURRENT}' THEN hardware_fingerprint END) AS n_current,
 concat_ws(chr(10), CASE WHEN (SELECT count(*) FROM ((SELECT DISTINCT hardware_fingerprint FROM traces WHERE run_label = '{BASELINE}' EXCEPT SELECT hardware_fingerprint FROM traces WHERE run_label = '{CURRENT}') UNION ALL (SELECT DISTINCT hardware_fingerprint FROM traces WHERE run_label = '{CURRENT}' EXCEPT SELECT hardware_fingerprint FROM traces WHERE run_label = '{BASELINE}'))) > 0 THEN 'baseline and current runs used different hardware' END,
 CASE WHEN count(DISTINCT CASE WHEN run_label = '{CURRENT}' THEN hardware_fingerprint END) > 1 THEN 'the current runs used more than one hardware' END) AS warning FROM traces"""
)
def trace_hw_confound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.hardware_confound(history(spark, sf_dir), BASELINE, CURRENT)


@query(_TRACES + "SELECT call_site, operator, dtype, selected_kernel, count(*) AS calls, min(row_count) AS min_rows, max(row_count) AS max_rows FROM traces GROUP BY ALL")
def trace_kernel_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.kernel_log(history(spark, sf_dir))


_UPPER = "list(runtime_ns ORDER BY runtime_ns)[CAST(floor(count(*) / 2) AS BIGINT) + 1]"


@query(
    _TRACES
    + f""", own AS (SELECT {_KEYS}, sum(runtime_ns) AS total_ns, {_UPPER} AS median_ns, count(*) AS calls FROM traces WHERE run_label = '{CURRENT}' GROUP BY {_KEYS})
 SELECT {_KEYS}, round(total_ns, 3) AS total_ns, median_ns, calls, round(coalesce(100 * total_ns / nullif(sum(total_ns) OVER (), 0), 0), 9) AS percent FROM own"""
)
def trace_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.profile(history(spark, sf_dir), CURRENT).select(*tr.KEY, F.round("total_ns", 3).alias("total_ns"), "median_ns", "calls", F.round("percent", 9).alias("percent"))


@query(_TRACES + "SELECT dtype, row_count, round(avg(selectivity), 9) AS selectivity FROM traces WHERE operator = 'filter' AND selectivity IS NOT NULL GROUP BY dtype, row_count")
def trace_avg_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.average_selectivity(history(spark, sf_dir)).withColumn("selectivity", F.round("selectivity", 9))


_LOST = f"SELECT {_KEYS}, call_site, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY timestamp, id) AS r FROM traces WHERE run_label = '{CURRENT}' AND contiguous = 0) WHERE r = 1"


@query(_TRACES + _LOST)
def trace_first_contiguity_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.first_contiguity_loss(history(spark, sf_dir), CURRENT)


@query(_TRACES + f"SELECT {_KEYS}, count(*) AS n FROM traces WHERE contiguous = 1 GROUP BY {_KEYS}")
def trace_contiguous_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.contiguous_samples(history(spark, sf_dir)).select(*tr.KEY, F.size("accelerated").cast("long").alias("n"))


@query(_TRACES + f"SELECT {_KEYS} FROM traces WHERE run_label = '{BASELINE}' INTERSECT SELECT {_KEYS} FROM traces WHERE run_label = '{CURRENT}'")
def trace_common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return tr.labelled(h, BASELINE).select(*tr.KEY).intersect(tr.labelled(h, CURRENT).select(*tr.KEY))


@query(
    """SELECT event_id, CASE WHEN operator = 'reduction' THEN v WHEN operator = 'filter' AND s BETWEEN 0.3 AND 0.7 THEN v ELSE 'scalar' END AS kernel FROM (
 SELECT *, CASE WHEN n >= 5000000 AND threads > 1 THEN 'mt_avx2' ELSE 'avx2' END AS v, CASE WHEN raw BETWEEN 0 AND 1 THEN raw ELSE 0.5 END AS s FROM (
 SELECT event_id, CASE event_type WHEN 'click' THEN 'projection' WHEN 'purchase' THEN 'reduction' WHEN 'signup' THEN 'rolling' ELSE 'filter' END AS operator, event_id % 20 * 500000 AS n, user_id % 9 AS threads, value / 400 AS raw FROM events))"""
)
def kernel_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    kind = F.col("event_type")
    operator = F.when(kind == "click", "projection").when(kind == "purchase", "reduction").when(kind == "signup", "rolling").otherwise("filter")
    return e.select("event_id", select_kernel(operator, F.col("event_id") % 20 * 500_000, F.col("user_id") % 9, F.col("value") / 400).alias("kernel"))


@query(
    _TRACES
    + f""", h AS (SELECT 'filter' AS operator, dtype, row_count, avg(selectivity) AS s FROM traces WHERE operator = 'filter' AND selectivity IS NOT NULL GROUP BY dtype, row_count)
 SELECT {_KEYS}, round(s, 9) AS selectivity, CASE WHEN operator = 'reduction' OR operator = 'filter' AND coalesce(s, 0.5) BETWEEN 0.3 AND 0.7 THEN 'avx2' ELSE 'scalar' END AS kernel FROM (SELECT DISTINCT {_KEYS} FROM traces) LEFT JOIN h USING ({_KEYS})"""
)
def kernel_selection_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return selected(h.select(*tr.KEY).distinct(), h, 8).withColumn("selectivity", F.round("selectivity", 9))


@query(_TRACES + f"SELECT {_KEYS}, call_site, count(*) AS n FROM traces WHERE run_label = '{BASELINE}' GROUP BY {_KEYS}, call_site")
def trace_samples_by_call_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.samples(history(spark, sf_dir), BASELINE, by_call_site=True).select(*tr.KEY, "call_site", "n")


@query(_TRACES + "SELECT DISTINCT dtype, row_count, row_count * CASE dtype WHEN 'float64' THEN 8 ELSE 4 END / 2.0::DOUBLE AS copy_cost_ns FROM traces")
def copy_cost_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("dtype", "row_count").distinct().withColumn("copy_cost_ns", copy_cost(F.col("row_count"), F.col("dtype"), 2.0))


@query(
    _TRACES
    + f""", s AS (SELECT {_KEYS}, {_UPPER} AS m FROM traces WHERE run_label = '{CURRENT}' GROUP BY {_KEYS}), a AS (SELECT {_KEYS}, {_UPPER} AS m FROM traces WHERE contiguous = 1 GROUP BY {_KEYS}),
 j AS (SELECT s.operator, s.dtype, s.row_count, s.row_count * CASE s.dtype WHEN 'float64' THEN 8 ELSE 4 END / 2.0::DOUBLE AS c, s.m - a.m AS d FROM s LEFT JOIN a USING ({_KEYS}))
 SELECT {_KEYS}, c AS copy_cost_ns, round(d, 6) AS savings_ns, round(d - c, 6) AS net_benefit_ns, coalesce(d > c * 2, false) AS recommend, CASE WHEN d IS NULL THEN 'no run on the fast path is known for this shape' END AS reason FROM j"""
)
def remediation_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = remediation(shapes_for_remediation(history(spark, sf_dir), CURRENT), 2.0)
    return told.select(*tr.KEY, "copy_cost_ns", F.round("savings_ns", 6).alias("savings_ns"), F.round("net_benefit_ns", 6).alias("net_benefit_ns"), "recommend", "reason")


def _side(label: str) -> str:
    return f"(SELECT {_KEYS}, list(runtime_ns ORDER BY runtime_ns) AS s, len(s) AS n, avg(runtime_ns) AS m FROM traces WHERE run_label = '{label}' GROUP BY {_KEYS})"


def _draw(side: str, salt: int) -> str:
    place = f"(i * 65537 + k * 257 + {salt}) % 2147483647"
    for factor, shift in ((48271, 11), (69621, 12345)):
        place = f"list_transform([({place} * {factor} + {shift}) % 2147483647], lambda x: (x * x + {shift}) % 2147483647)[1]"
    return f"list_sum(list_transform(range({side}.n), lambda k: {side}.s[(({place} * {side}.n) >> 31) + 1])) / {side}.n"


_BOOT = (
    _TRACES
    + f""", g AS (SELECT b.*, c.s AS cs, c.n AS cn, c.m AS cm, count(*) OVER () AS k FROM {_side(BASELINE)} b JOIN {_side(CURRENT)} c USING ({_KEYS})),
 j AS (SELECT {_KEYS}, i, {{'s': s, 'n': n}} AS b, {{'s': cs, 'n': cn}} AS c FROM g, range({BOOTSTRAPS}) t(i)),
 d AS (SELECT {_KEYS}, {_draw('b', 2)} AS x, {_draw('c', 3)} AS y FROM j),
 r AS (SELECT {_KEYS}, list(coalesce((y - x) / nullif(x, 0), 0) ORDER BY coalesce((y - x) / nullif(x, 0), 0)) AS draws FROM d GROUP BY {_KEYS}),
 ci AS (SELECT {_KEYS}, n AS nb, cn AS nc, k, CASE WHEN least(n, cn) >= 2 THEN coalesce((cm - m) / nullif(m, 0), 0) END AS e,
  CASE WHEN least(n, cn) >= 2 THEN draws[CAST(floor({BOOTSTRAPS} * (0.05::DOUBLE / greatest(k, 1) / 2)) AS BIGINT) + 1] END AS lo,
  CASE WHEN least(n, cn) >= 2 THEN draws[CAST(least(floor({BOOTSTRAPS} * (1 - 0.05::DOUBLE / greatest(k, 1) / 2)), {BOOTSTRAPS} - 1) AS BIGINT) + 1] END AS hi FROM g LEFT JOIN r USING ({_KEYS}))
"""
)


@query(_BOOT + f"SELECT {_KEYS}, nb AS n_baseline, nc AS n_current, k AS comparisons, round(e, 9) AS estimate, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high FROM ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    told = bootstrap_intervals(tr.samples(h, BASELINE), tr.samples(h, CURRENT), BOOTSTRAPS)
    return told.withColumns({c: F.round(c, 9) for c in ("estimate", "ci_low", "ci_high")})


@query(_BOOT + f", lost AS ({_LOST}) SELECT ci.operator, ci.dtype, ci.row_count, CASE WHEN least(nb, nc) < 20 THEN 'insufficient_data' WHEN lo > 0.001 THEN 'regression' ELSE 'within_noise' END AS status, CASE WHEN least(nb, nc) >= 20 AND lo > 0.001 THEN lost.call_site END AS lost_at FROM ci LEFT JOIN lost ON ci.operator = lost.operator AND ci.dtype = lost.dtype AND ci.row_count = lost.row_count")
def regression_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression_report(history(spark, sf_dir), BASELINE, CURRENT, threshold=0.001, n_bootstrap=BOOTSTRAPS).select(*tr.KEY, "status", "lost_at")


@query(
    """WITH s AS (SELECT event_type AS stage, event_type IN ('click', 'purchase') AS accelerated, value * 1000 AS ns FROM events), o AS (SELECT stage, sum(ns) AS t, sum(CASE WHEN accelerated THEN ns ELSE 0 END) AS a, list(ns ORDER BY ns)[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS m FROM s GROUP BY stage)
 SELECT stage, round(t, 3) AS total_ns, round(a, 3) AS accelerated_ns, m AS median_ns, round(t / nullif(sum(t) OVER (), 0), 9) AS share FROM o"""
)
def stage_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir, "event_type").select(F.col("event_type").alias("stage"), F.col("event_type").isin("click", "purchase").alias("accelerated"), (F.col("value") * 1000).alias("ns"))
    return tr.stage_breakdown(e).select("stage", F.round("total_ns", 3).alias("total_ns"), F.round("accelerated_ns", 3).alias("accelerated_ns"), "median_ns", F.round("share", 9).alias("share"))


@query("SELECT round(median(value), 9) AS median FROM events")
def true_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).agg(F.round(F.median("value"), 9).alias("median"))
