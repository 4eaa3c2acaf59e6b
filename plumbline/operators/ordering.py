"""Dense row numbers and block-halo windows: global order without a single task.

A window over a whole table would move all rows to one task.  Instead rows are range-partitioned by
the order columns, numbered within partitions, and offset by the counts of the partitions before.
Blocks of consecutive numbers, each with copies of the rows just before it, are then independent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline.plans.materialize import guarded, table

#: Rows up to which one task takes the whole window, and rows of a block beyond that.
SINGLE_TASK_ROWS, BLOCK_ROWS = 1_000_000, 200_000
#: Rows up to which a moving frame is summed anew at each row; wider ones are put together from parts.
FRAME_ROWS = 256
ROW = "_row"


def numbered(df: DataFrame, order: list[str], partitions: int | None = None, row: str = ROW) -> DataFrame:
    """``df`` with ``row``: 0-based, dense, in ``order``, whose values must be unique.

    The range partitions, of about BLOCK_ROWS rows, are written once, so that counts and numbers see the same ones.
    """
    spark = df.sparkSession
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BLOCK_ROWS))
    pinned = table(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    counts = sorted((r["_part"], r["n"]) for r in pinned.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    offsets = spark.createDataFrame(offsets, "_part int, _before long")
    within = Window.partitionBy("_part").orderBy(*order)
    joined = pinned.withColumn("_nth", F.row_number().over(within)).join(guarded(offsets, len(counts)), "_part")
    return joined.withColumn(row, F.col("_before") + F.col("_nth") - 1).drop("_part", "_nth", "_before")


def haloed(df: DataFrame, order: list[str], width: int, make: Callable[[WindowSpec], dict[str, Column]], block: int = BLOCK_ROWS, by: list[str] = [], row: str = ROW) -> DataFrame:  # noqa: B006
    """Adds the columns of ``make`` over the last ``width`` rows in ``order``, within ``by``, block by block.

    Blocks are of consecutive rows in the order of ``by`` and ``order`` together, so a large group
    has many, and small ones share one.  ``row`` counts within ``by``.
    """
    block = max(block, width)
    rows = numbered(df, [*by, *order], row=row)
    own = F.floor(F.col(row) / block)
    near = F.when(F.col(row) % block >= block - (width - 1), F.array(own, own + 1)).otherwise(F.array(own))
    spread = rows.withColumn("_block", F.explode(near))
    window = Window.partitionBy("_block", *by).orderBy(row)
    out = spread.withColumns(make(window)).where(F.col("_block") == own).drop("_block")
    if not by:
        return out
    first = rows.groupBy(*by).agg(F.min(row).alias("_first"))
    return out.join(first.select(*(first[k].alias(f"_by_{k}") for k in by), "_first"), [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by]).withColumn(row, F.col(row) - F.col("_first")).drop("_first", *(f"_by_{k}" for k in by))


def windowed(df: DataFrame, order: list[str], by: list[str], width: int, make: Callable[[WindowSpec], dict[str, Column]], strategy: str = "auto", most: Callable[[], int] | None = None, row: str = ROW) -> DataFrame:
    """Adds windowed columns and ``row`` (0-based within ``by``) by the strategy that fits the size.

    ``most`` tells the rows of the largest group; up to SINGLE_TASK_ROWS one task takes a group.
    """
    if strategy == "auto":
        strategy = "window" if (most() if most else df.count()) <= SINGLE_TASK_ROWS else "halo"
    if strategy == "halo":
        return haloed(df, order, width, make, by=by, row=row)
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({**make(window), row: F.row_number().over(window).cast("long") - 1})


def wide_sums(df: DataFrame, value: str, order: list[str], by: list[str], width: int, row: str, total: str, spread: str | None = None, strategy: str = "auto", most: Callable[[], int] | None = None) -> DataFrame:
    """The rows with ``width`` rows up to them within ``by``, with ``row``, the ``total`` of ``value`` over those and, if asked for, its ``spread`` (the sum of squared deviations).

    A frame is the end of one block, whole blocks and the start of another.  Starts and ends come from
    running sums in both directions, so each row is summed three times, whatever the width, and no sum
    is a difference of larger ones.  ``value`` must have no nulls.
    """
    if width < 2:
        raise ValueError("a frame of parts has two rows at least")
    block = min(BLOCK_ROWS, width - 1)
    whole, rest = divmod(width - 1, block)
    keys = [f"by{k}" for k in range(len(by))]
    # the columns of df are held in one, so that none can clash
    rows = windowed(df, order, by, 1, lambda w: {}, strategy, most=most, row=row)
    rows = rows.select(F.struct(*rows.columns).alias("held"), *(F.col(k).alias(name) for k, name in zip(by, keys)), F.col(row).alias("row"), F.col(value).cast("double").alias("x"))
    rows = rows.withColumn("block", F.floor(F.col("row") / block))
    own = Window.partitionBy(*keys, "block")
    place = F.col("row") % block

    def running(part: str, n: Column, w: WindowSpec) -> dict[str, Column]:
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        return {f"{part}_n": n, part: F.sum("x").over(w)} | ({f"{part}_m2": F.var_pop("x").over(w) * n} if spread else {})

    parts = ["tail", "between", "head"]
    ends = rows.withColumns(running("head", place + 1, own.orderBy("row"))).where(F.col("row") >= width - 1)
    starts = rows.withColumns(running("tail", block - place, own.orderBy(F.desc("row")))).withColumn("row", F.col("row") + (width - 1))
    starts = starts.select(*(F.col(k).alias(f"of_{k}") for k in (*keys, "row")), *(c for c in starts.columns if c.startswith("tail")))
    blocks = rows.groupBy(*keys, "block").agg(F.sum("x").alias("x"), *([(F.var_pop("x") * F.count("x")).alias("m2")] if spread else []))  # a row for each block of a group

    def before(name: str, n: int) -> dict[str, Column]:
        """Sums over the ``n`` blocks before, all of which are full."""
        if not n:
            return {name: F.lit(0.0)} | ({f"{name}_m2": F.lit(0.0)} if spread else {})
        w = Window.partitionBy(*keys).orderBy("block").rowsBetween(-n, -1)
        return {name: F.sum("x").over(w)} | ({f"{name}_m2": F.sum("m2").over(w) + F.var_pop(F.col("x") / block).over(w) * block * n} if spread else {})

    blocks = blocks.withColumns(before("near", whole - 1) | before("far", whole))
    blocks = blocks.select(*(F.col(k).alias(f"at_{k}") for k in (*keys, "block")), *(c for c in blocks.columns if c.startswith(("near", "far"))))
    same = lambda prefix, last: [*(F.col(k).eqNullSafe(F.col(f"{prefix}_{k}")) for k in keys), F.col(last) == F.col(f"{prefix}_{last}")]
    out = ends.join(blocks, same("at", "block")).join(starts, same("of", "row"))
    chosen = lambda last: F.when(place >= rest, F.col(f"near{last}")).otherwise(F.col(f"far{last}"))
    out = out.withColumns({"between_n": width - F.col("head_n") - F.col("tail_n"), "between": chosen("")} | ({"between_m2": chosen("_m2")} if spread else {}))
    some = lambda part, x: F.when(F.col(f"{part}_n") > 0, x).otherwise(0.0)
    out = out.withColumn("total", sum(some(p, F.col(p)) for p in parts))
    told = [F.col("total").alias(total)]
    if spread:
        apart = lambda p: F.col(p) / F.col(f"{p}_n") - F.col("total") / width
        told.append(sum(some(p, F.col(f"{p}_m2") + F.col(f"{p}_n") * apart(p) * apart(p)) for p in parts).alias(spread))
    return out.select("held.*", *told)
