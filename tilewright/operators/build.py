"""Sort-tile packing as rank arithmetic: two ranks give every row its page and slot, one aggregate gives the nodes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import shape
from ..sources.scratch import discard, written
from .rank import ONE_TASK_ROWS, global_rank


@dataclass
class RectIndex:
    """``entries`` (ENTRY_SCHEMA), ``nodes`` (page, level, node_count and box) and ``meta`` (one row)."""

    entries: DataFrame
    nodes: DataFrame
    meta: DataFrame
    pages: list[int]  #: of each level, leaves first
    root_page: int
    kept: list[DataFrame] = field(default_factory=list)  #: levels written to the shared folder

    def release(self) -> None:
        """Delete the levels that packing wrote. Nothing of this index can be read afterwards."""
        for level in self.kept:
            discard(level)
        self.kept.clear()

    def __enter__(self) -> RectIndex:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    @property
    def height(self) -> int:
        return len(self.pages)


def str_ranked(level: DataFrame, n: int, cap: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``level`` (box and child) with rank_x, slice and rank_y. Ties: by child on x, by rank_x on y."""
    width = shape.slice_width(n, cap)
    ranked = global_rank(level, [G.key_x(), F.col("child")], "rank_x", n, one_task_rows).withColumn("slice", F.expr(f"rank_x div {width}L"))
    return ranked.withColumn("rank_y", F.row_number().over(Window.partitionBy("slice").orderBy(G.key_y(), "rank_x")).cast("long") - 1)


def str_level(level: DataFrame, n: int, cap: int, base_page: int, number: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Entries of one level, with the slice that they lie in. An internal level of one page keeps the order of its children."""
    if number and n <= cap:
        ranked = level.withColumn("slice", F.lit(0).cast("long")).withColumn("rank_y", F.row_number().over(Window.orderBy("child")).cast("long") - 1)
    else:
        ranked = str_ranked(level, n, cap, one_task_rows)
    pages_of_slice = shape.slice_width(n, cap) // cap
    return ranked.select(
        F.lit(number).alias("level"), (F.expr(f"slice * {pages_of_slice}L + rank_y div {cap}L") + F.lit(base_page)).alias("page"),
        F.expr(f"cast(rank_y % {cap} as int)").alias("slot"), F.lit(number == 0).alias("is_leaf"), *G.SIDES, "child", "slice",
    )


def level_nodes(entries: DataFrame) -> DataFrame:
    """Box and size of each page. Grouping by slice as well reuses the dealing of the rank: a page lies inside one slice."""
    return entries.groupBy("slice", "page").agg(F.first("level").alias("level"), F.count(F.lit(1)).alias("node_count"), *G.union_of()).select("page", "level", "node_count", *G.SIDES)


def build_index(rects: DataFrame, fill: float | None = None, fill_leaf: float = 1.0, fill_internal: float = 1.0, leaf_cap: int | None = None, internal_cap: int | None = None, one_task_rows: int = ONE_TASK_ROWS) -> RectIndex:
    """Pack ``rects`` (id and box) into a tree. ``fill`` sets both factors; capacities override factors.

    Leaves are pages 1.., then each level in turn; the root is last. Levels are written to the shared folder until ``release()``. Raises ValueError for an empty input or a factor outside
    (0, 1]; faulty rows raise when they are read."""
    spark = rects.sparkSession
    if fill is not None:
        fill_leaf = fill_internal = fill
    leaf_cap, internal_cap = leaf_cap or shape.capacity(fill_leaf), internal_cap or shape.capacity(fill_internal)
    rects = G.checked(rects)
    n = rects.count()
    pages = shape.level_pages(n, leaf_cap, internal_cap)
    level, size, base, parts, nodes, kept = rects.select(*G.SIDES, F.col("id").alias("child")), n, 1, [], [], []
    for number, count in enumerate(pages):
        entries = str_level(level, size, leaf_cap if number == 0 else internal_cap, base, number, one_task_rows)
        # read for its nodes, for the entries and by every query: written once, so it is packed once and outlives executors; the
        # folder goes with release() or the driver, and no executor memory is taken
        entries = written(entries, f"level{number}")
        kept.append(entries)
        own = level_nodes(entries)
        parts.append(entries.drop("slice"))
        nodes.append(own)
        level, size, base = own.select(*G.SIDES, F.col("page").alias("child")), count, base + count
    index = RectIndex(reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, nodes), None, pages, sum(pages), kept)
    index.meta = tree_meta(spark, index, nodes[-1], n, leaf_cap, internal_cap, fill_leaf, fill_internal)
    return index


def tree_meta(spark: SparkSession, index: RectIndex, root: DataFrame, n: int, leaf_cap: int, internal_cap: int, fill_leaf: float, fill_internal: float) -> DataFrame:
    """One row of what a tree file's header holds."""
    fixed = {
        "page_bytes": shape.PAGE_BYTES, "height": index.height, "max_entries_per_page": shape.MAX_ENTRIES, "leaf_cap": leaf_cap, "internal_cap": internal_cap,
        "num_rects": n, "num_nodes": sum(index.pages), "root_page": index.root_page,
    }
    return root.select(*(F.lit(v).cast("long").alias(k) for k, v in fixed.items()), G.lit32(fill_leaf).alias("fill_leaf"), G.lit32(fill_internal).alias("fill_internal"), *(F.col(s).alias(f"root_{s}") for s in G.SIDES))


def checked_shape(index: RectIndex) -> DataFrame:
    """Pages of each level as packed against the closed form."""
    expected = index.entries.sparkSession.createDataFrame([(k, p) for k, p in enumerate(index.pages)], "level int, expected long")
    found = index.nodes.groupBy("level").agg(F.count(F.lit(1)).alias("pages"))
    return expected.join(F.broadcast(found), "level", "left")
