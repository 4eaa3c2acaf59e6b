"""Sharding by sampled splitters.

Records are ordered by a key that starts with the checksum of the text, so equal texts are
neighbours, and ends with a hash of the id, so a large group of equal texts can still be split.
A size-weighted sample of keys gives quantile boundaries; ranges that turn out overfull are
subdivided by a sample of their own.  Exact totals of the ranges, summed up in key order, place
every record on one axis of bytes, which is cut into equal shards at record boundaries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import columns, free, ship, table

#: Records meant for a range, bounds on the number of ranges, sampled keys for each range.
RANGE_ROWS, MIN_RANGES, MAX_RANGES, OVERSAMPLE = 20_000, 64, 1 << 16, 16
#: A range is overfull from this many times its share of bytes or rows; rounds of subdivision.
OVERFULL, ROUNDS = 2.0, 6


def _draw(share: Column, seed: int) -> Column:
    """True with probability ``share``, the same at each evaluation."""
    return F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 11) < share * F.lit(float(1 << 53))


def quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """At most ``parts`` - 1 splitters that cut the weighted keys evenly."""
    if not keys.size or parts < 2:
        return np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    total = np.cumsum(weights[order])
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[order][np.minimum(at, keys.size - 1)])


def _ranged(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(splitters)  # MAX_RANGES numbers, and what subdivision adds

    @F.pandas_udf(T.IntegerType())
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, key.to_numpy(), side="right").astype(np.int32))

    return rows.withColumn("range", place("key"))


def _totals(ranged: DataFrame) -> pd.DataFrame:
    kinds = [F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")]
    return ranged.groupBy("range").agg(*kinds).toPandas().sort_values("range", ignore_index=True)


def shard_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 7) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``shard`` and ``slot``.

    ``size`` is the text's UTF-8 bytes plus 1 (null and empty: 1; their checksum is 0).  A record
    belongs to the shard in which its middle byte falls, so shards differ from an equal share by
    less than one record.  ``slot`` counts from 0 without gaps in each shard, in key order.
    Equal texts are neighbours, but a group of them that lies across the end of a shard is cut there,
    and texts of one checksum may mix.  Repeated rows are records like any others and stay
    neighbours; null ids sort first; further columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.col("_text")
    rows = columns(docs, id_col, text_col).select(
        "_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
    )
    key = F.col("crc") * F.lit(1 << 31) + F.pmod(F.xxhash64("_id"), F.lit(1 << 31))
    rows = table(rows.withColumns({"key": key, "salt": F.xxhash64(F.monotonically_increasing_id())}), "shard-rows")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total, count = total or 1, count or 0
    n_ranges = int(min(MAX_RANGES, max(MIN_RANGES, count // RANGE_ROWS)))
    wanted = n_ranges * OVERSAMPLE
    drawn = rows.where(_draw(F.col("size") * F.lit(wanted / total), seed)).select("key", "size").toPandas()
    splitters = quantiles(drawn["key"].to_numpy(np.int64), np.maximum(drawn["size"].to_numpy(float), total / wanted), n_ranges)
    share = max(RANGE_ROWS, count / n_ranges)
    for k in range(ROUNDS):
        ranged = _ranged(rows, splitters)
        found = _totals(ranged)
        full = np.maximum(found["bytes"] * n_ranges / total, found["rows"] / share)
        over = found[(full > OVERFULL) & (found["low"] < found["high"])]
        if over.empty or k == ROUNDS - 1:
            break
        parts = np.ceil(full[over.index] * 2).astype(int)
        small = spark.createDataFrame(list(zip(over["range"].tolist(), over["bytes"].astype(float).tolist(), over["rows"].astype(float).tolist(), parts.tolist())), "range int, bytes double, rows double, parts int")
        odds = F.col("parts") * F.lit(OVERSAMPLE / 2) * (F.col("size") / F.col("bytes") + 1 / F.col("rows"))
        more = ranged.join(F.broadcast(small), "range").where(_draw(odds, seed + 1 + k)).select("range", "key", "parts").toPandas()
        fresh = [quantiles(g["key"].to_numpy(np.int64), np.ones(len(g)), int(g["parts"].iloc[0])) for _, g in more.groupby("range")]
        before, splitters = splitters, np.unique(np.concatenate([splitters, *fresh]))
        if splitters.size == before.size:
            break
    # a range of one key only, such as a repeated row, is dealt by salt: its rows are alike
    alike = found[(full > OVERFULL) & (found["low"] == found["high"])]
    dealt = spark.createDataFrame([(int(r), int(n)) for r, n in zip(alike["range"], np.ceil(full[alike.index] * 2))], "range int, parts int")
    ranged = ranged.join(F.broadcast(dealt), "range", "left").withColumn("sub", F.coalesce(F.pmod("salt", "parts"), F.lit(0)).cast("int"))
    found = ranged.groupBy("range", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values(["range", "sub"], ignore_index=True)
    offsets = spark.createDataFrame(
        list(zip(found["range"].tolist(), found["sub"].tolist(), (found["bytes"].cumsum() - found["bytes"]).astype(int).tolist(), (found["rows"].cumsum() - found["rows"]).astype(int).tolist())),
        "range int, sub int, bytes_before long, rows_before long",
    )
    inside = Window.partitionBy("range", "sub").orderBy("key", "_id")
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["range", "sub"])
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")) * F.lit(shards) / F.lit(2 * total))).cast("int"))
        .withColumn("row", F.col("rows_before") + F.col("nth") - 1)
    )
    placed = table(placed.select("_id", "size", "crc", "shard", "row"), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(F.col("_id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, files_per_shard: int = 8) -> None:
    """Writes ``docs`` to ``path``, one folder ``shard=...`` for each shard; rows equal in id and text share one.

    All columns are kept; if one is named ``shard``, the folders' name gets underscores in front.
    Null ids and texts are written like others; no rows give an empty table.
    """
    shard, key, crc = (free(x, docs.columns) for x in ("shard", "shard_key", "shard_crc"))
    plan = shard_plan(docs, id_col=id_col, text_col=text_col, shards=shards)
    where = plan.groupBy(F.col(id_col).alias(key), F.col("text_crc32").alias(crc)).agg(F.min("shard").alias(shard))
    sums = F.crc32(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"))
    own = docs.join(where, docs[id_col].eqNullSafe(where[key]) & (sums == where[crc])).drop(key, crc)
    salt = F.pmod(F.xxhash64(id_col, text_col), F.lit(files_per_shard))
    own.repartition(shards * files_per_shard, shard, salt).write.partitionBy(shard).parquet(path)
