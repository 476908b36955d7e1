"""Global ranks: by a window in one task for few rows, else by range partitions and their offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

#: Rows up to which one task ranks them all.
ONE_TASK_ROWS = 1_000_000


def global_rank(df: DataFrame, order: list[Column], name: str, rows: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``df`` with ``name``, its 0-based rank in a total order of ``rows`` rows.

    Beyond ``one_task_rows`` the rows are range-partitioned and sorted, written once so that their layout is fixed, and a row's
    rank is its place in its partition plus the rows of the partitions before: one small count for each partition."""
    if rows <= one_task_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    keys = [f"_k{k}" for k in range(len(order))]
    keyed = df.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True)))
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    row = F.monotonically_increasing_id()  # partition << 33 | row of the partition
    placed = written(placed.select("*", F.shiftright(row, 33).alias("_part"), row.bitwiseAND((1 << 33) - 1).alias("_row")), "ranked")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")
