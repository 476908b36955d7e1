"""Schemas, fixed values and column expressions over bounding boxes. Coordinates are float32 throughout."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sides of a box, in the order of every interchange format.
SIDES = ("min_x", "min_y", "max_x", "max_y")
RECT_SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), *(T.StructField(s, T.FloatType(), False) for s in SIDES)])
ENTRY_SCHEMA = T.StructType([
    T.StructField("level", T.IntegerType(), False), T.StructField("page", T.LongType(), False), T.StructField("slot", T.IntegerType(), False),
    T.StructField("is_leaf", T.BooleanType(), False), *(T.StructField(s, T.FloatType(), False) for s in SIDES), T.StructField("child", T.LongType(), False),
])

Box = tuple[float, float, float, float]


def f32(value: float) -> float:
    """``value`` rounded to float32, as a Python float."""
    return struct.unpack("<f", struct.pack("<f", value))[0]


def lit32(value: float) -> Column:
    """A float32 literal: a double literal would compare differently with a float column."""
    return F.lit(float(value)).cast("float")


def sides(prefix: str = "") -> list[Column]:
    return [F.col(prefix + s) for s in SIDES]


def box_columns(box: Box) -> list[Column]:
    return [lit32(v) for v in box]


def intersects(a: list[Column], b: list[Column]) -> Column:
    """Closed: touching edges and corners count. Inverted boxes are evaluated as they are; NaN bounds meet nothing."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def contains(outer: list[Column], inner: list[Column]) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def contains_point(box: list[Column], x: Column, y: Column) -> Column:
    return (box[0] <= x) & (box[2] >= x) & (box[1] <= y) & (box[3] >= y)


def key_x() -> Column:
    """Sum of both sides in float32: orders like the centre."""
    return F.col("min_x") + F.col("max_x")


def key_y() -> Column:
    return F.col("min_y") + F.col("max_y")


def union_of() -> list[Column]:
    """The least box around a group: partial and final minima and maxima."""
    return [F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")]


def has_nan(values) -> bool:
    return any(math.isnan(v) for v in values)


def faulty() -> Column:
    """Rows that no index takes: null, NaN or infinite sides, null or negative ids."""
    bad = F.col("id").isNull() | (F.col("id") < 0)
    for s in SIDES:
        bad = bad | F.col(s).isNull() | F.isnan(s) | (F.abs(F.col(s)) == float("inf"))
    return bad


def checked(rects: DataFrame) -> DataFrame:
    """``rects`` in the canonical schema; a faulty row raises when it is read."""
    ok = F.when(faulty(), F.raise_error(F.lit("rectangles need finite sides and ids of at least 0")).cast("boolean")).otherwise(F.lit(True))
    return rects.select(F.col("id").cast("long").alias("id"), *(F.col(s).cast("float").alias(s) for s in SIDES)).filter(ok)


def human_bytes(n: float) -> str:
    """1536 -> '1.50 KB'."""
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.0f} B" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError
