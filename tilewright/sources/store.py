"""An index as Parquet tables: entries by level, nodes, and the one-row header written last, as a commit mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.build import RectIndex


def save_index(index: RectIndex, path: str) -> None:
    """Entries are range-dealt and sorted by page within their level, so row groups cover small areas and their minima and
    maxima prune scans."""
    placed = index.entries.repartitionByRange("level", "page").sortWithinPartitions("level", "page", "slot")
    placed.write.mode("overwrite").partitionBy("level").parquet(f"{path}/entries")
    index.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    index.meta.withColumn("level_pages", F.array(*[F.lit(p).cast("long") for p in index.pages])).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> RectIndex:
    """Raises Spark's PATH_NOT_FOUND where there is no index, and ValueError where its header is missing."""
    rows = spark.read.parquet(f"{path}/meta").head(1)
    if not rows:
        raise ValueError(f"{path} holds no finished index")
    pages = [int(p) for p in rows[0]["level_pages"]]
    entries = spark.read.schema(G.ENTRY_SCHEMA).parquet(f"{path}/entries")
    return RectIndex(entries, spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/meta").drop("level_pages"), pages, sum(pages))


def load_rects(spark: SparkSession, path: str) -> DataFrame:
    """Rectangles from Parquet in the canonical schema."""
    return spark.read.schema(G.RECT_SCHEMA).parquet(path)
