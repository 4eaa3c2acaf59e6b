"""Synthetic prices: exponentials of a drifting random walk."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.prefix import prefix_sums

DRIFT, VOLATILITY, START = 2e-4, 0.01, 100.0


def fixture(spark: SparkSession, n: int = 1_000_000, seed: int = 42) -> DataFrame:
    """(idx, price) drawn by NumPy on the driver: for tests that need exact values."""
    steps = np.random.default_rng(seed).normal(DRIFT, VOLATILITY, n)
    prices = np.exp(np.cumsum(steps) + math.log(START))
    return spark.createDataFrame([(i, float(p)) for i, p in enumerate(prices)], "idx long, price double")


def generate(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(idx, price) made where it is needed, for any ``n``; the values differ from ``fixture``'s."""
    steps = spark.range(n).select(F.col("id").alias("idx"), (F.randn(seed) * VOLATILITY + DRIFT).alias("price"))
    walk = prefix_sums(steps, "price", ["idx"], [])
    return walk.select("idx", F.exp(F.col("price") + math.log(START)).alias("price"))
