"""Synthetic rectangles from md5 digests of the id: the same rows for the same seed, however they are partitioned, and in any engine
that has md5."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Defaults: side of the square that corners lie in, least and most side of a rectangle, seed.
EXTENT, LEAST, MOST, SEED = 1000.0, 0.1, 10.0, 42


#: Hexadecimal digits of a digest that make a number: 52 bits are exact in a double.
DIGITS = 13


def draw(key: Column, name: str, seed: int) -> Column:
    """A long in [0, 2^52) from the text ``seed:name:key``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{name}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def uniform(key: Column, name: str, seed: int) -> Column:
    """A double in [0, 1)."""
    return draw(key, name, seed) * F.lit(2.0 ** (-4 * DIGITS))


def _validated(count: int, least: float, most: float) -> None:
    if count <= 0:
        raise ValueError("count must be positive")
    if not 0 < least <= most:
        raise ValueError("sides need 0 < least <= most")


def _boxes(rows: DataFrame, x: Column, y: Column, least: float, most: float, seed: int) -> DataFrame:
    side = lambda name: (F.lit(least) + uniform(F.col("id"), name, seed) * (most - least)).cast("float")
    rows = rows.select("id", x.cast("float").alias("min_x"), y.cast("float").alias("min_y"), side("w").alias("w"), side("h").alias("h"))
    return rows.select("id", "min_x", "min_y", (F.col("min_x") + F.col("w")).alias("max_x"), (F.col("min_y") + F.col("h")).alias("max_y"))


def uniform_rects(spark: SparkSession, count: int, extent: float = EXTENT, least: float = LEAST, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Lower corners uniform in [0, extent) squared, sides uniform in [least, most)."""
    _validated(count, least, most)
    return _boxes(spark.range(count), uniform(F.col("id"), "x", seed) * extent, uniform(F.col("id"), "y", seed) * extent, least, most, seed)


def clustered_rects(spark: SparkSession, count: int, clusters: int, extent: float = EXTENT, least: float = LEAST, most: float = MOST, seed: int = SEED) -> DataFrame:
    """Corners around ``clusters`` uniform centres with a deviation of extent / 100, clamped to [0, extent]."""
    _validated(count, least, most)
    if clusters < 1:
        raise ValueError("clusters must be positive")
    sigma, rows, own = extent / 100, spark.range(count), F.col("id")
    cluster = draw(own, "cluster", seed) % clusters
    centre = lambda axis: uniform(cluster, f"centre-{axis}", seed) * extent
    radius = F.sqrt(-2 * F.log(1 - uniform(own, "r", seed))) * sigma  # Box-Muller
    angle = uniform(own, "a", seed) * (2 * math.pi)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(extent), c))
    return _boxes(rows, clamp(centre("x") + radius * F.cos(angle)), clamp(centre("y") + radius * F.sin(angle)), least, most, seed)


def unit_squares(spark: SparkSession, count: int, extent: float = EXTENT, seed: int = 11) -> DataFrame:
    """Squares of side 1 for sort studies."""
    return uniform_rects(spark, count, extent, 1.0, 1.0, seed)
