"""Window, stabbing and count queries, their work statistics, and batches of queries.

A descent of the tree visits the root and every child whose stored box meets the query, and a child's box lies inside its
parent's. So the visited pages are the internal entries that meet the query, and one flat filter gives results and
statistics alike."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .build import RectIndex

#: Queries of a batch up to which they are sent to every task.
BROADCAST_QUERIES = 10_000
#: Bytes of internal entries up to which a level is sent to every task, and of one entry in memory.
BROADCAST_BYTES, ENTRY_MEMORY = 64 << 20, 64
#: Rows that the first page of a listing shows.
SHOWN = 20
#: Leaf entries: a stored index is partitioned by level, so that only their files are listed.
LEAVES = "level = 0"


def _found(index: RectIndex, meets: Column) -> DataFrame:
    return index.entries.filter(F.expr(LEAVES) & meets).select(F.col("child").alias("id"), *G.SIDES)


def _meets(box: G.Box) -> Column:
    return F.lit(False) if G.has_nan(box) else G.intersects(G.sides(), G.box_columns(box))


def _stabs(x: float, y: float) -> Column:
    return F.lit(False) if G.has_nan((x, y)) else G.contains_point(G.sides(), G.lit32(x), G.lit32(y))


def range_query(index: RectIndex, box: G.Box) -> DataFrame:
    """``id`` and box of every rectangle that meets ``box``; edges count. Inverted boxes are evaluated as they are."""
    return _found(index, _meets(box))


def range_count(index: RectIndex, box: G.Box) -> DataFrame:
    return index.entries.filter(F.expr(LEAVES) & _meets(box)).agg(F.count(F.lit(1)).alias("n"))


def point_query(index: RectIndex, x: float, y: float) -> DataFrame:
    return _found(index, _stabs(x, y))


def point_count(index: RectIndex, x: float, y: float) -> DataFrame:
    return index.entries.filter(F.expr(LEAVES) & _stabs(x, y)).agg(F.count(F.lit(1)).alias("n"))


def contained_query(index: RectIndex, box: G.Box) -> DataFrame:
    """Rectangles that lie inside ``box``."""
    return _found(index, F.lit(False) if G.has_nan(box) else G.contains(G.box_columns(box), G.sides()))


def first_hits(found: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first ``n`` by id: the listing that a query prints."""
    return found.orderBy("id").limit(n)


def _statistics(index: RectIndex, meets: Column) -> DataFrame:
    """One row: pages_read, entries_tested, entries_pruned, results. The root is read even if the query misses it."""
    visited = index.entries.filter(~F.expr(LEAVES) & meets).select(F.col("child").alias("page"))
    zero = F.lit(0).cast("long")
    hits = index.entries.filter(meets).select(F.when(F.col("is_leaf"), 0).otherwise(1).cast("long").alias("pages"), F.when(F.col("is_leaf"), 1).otherwise(0).cast("long").alias("results"), zero.alias("tested"))
    root = index.nodes.filter(F.col("page") == index.root_page)
    pages = index.nodes.join(visited, "page", "left_semi").unionByName(root)
    tested = pages.select(zero.alias("pages"), zero.alias("results"), F.col("node_count").alias("tested"))
    totals = hits.unionByName(tested).agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("pages", "results", "tested")))
    return totals.select((F.col("pages") + 1).alias("pages_read"), F.col("tested").alias("entries_tested"), (F.col("tested") - F.col("pages") - F.col("results")).alias("entries_pruned"), "results")


def range_stats(index: RectIndex, box: G.Box) -> DataFrame:
    return _statistics(index, _meets(box))


def point_stats(index: RectIndex, x: float, y: float) -> DataFrame:
    return _statistics(index, _stabs(x, y))


def page_entries(index: RectIndex, page: int) -> DataFrame:
    return index.entries.filter(F.col("page") == page)


def leaf_pages(index: RectIndex) -> DataFrame:
    return index.nodes.filter(F.col("level") == 0).select("page").orderBy("page")


def internal_pages(index: RectIndex) -> DataFrame:
    return index.nodes.filter(F.col("level") > 0).select("page").orderBy("page")


def _query_sides() -> list[Column]:
    return [F.col(f"q_{s}") for s in G.SIDES]


def _queries(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("qid").cast("long").alias("qid"), *(F.col(s).cast("float").alias(f"q_{s}") for s in G.SIDES)).filter(~F.isnan("q_min_x") & ~F.isnan("q_min_y") & ~F.isnan("q_max_x") & ~F.isnan("q_max_y"))


def batch_range_join(index: RectIndex, queries: DataFrame, broadcast_queries: int = BROADCAST_QUERIES) -> DataFrame:
    """``qid, id`` for every box of ``queries`` (qid and box) and rectangle that meet.

    Few queries go to every task and each rectangle is tested once against them. More are sent down the tree a level at a
    time, and meet the leaves by an equi-join on the page, then the exact test, so that no two large sides ever meet as a cross product."""
    q = _queries(queries)
    if q.limit(broadcast_queries + 1).count() <= broadcast_queries:
        leaves = index.entries.filter(LEAVES)
        return leaves.join(F.broadcast(q), G.intersects(G.sides(), _query_sides())).select("qid", F.col("child").alias("id"))
    return descend(index, q).select("qid", F.col("child").alias("id"))


def _level_bytes(index: RectIndex, level: int) -> int:
    """Memory of a level's entries; an entry of a level is a page of the one below, so sizes are known without a job."""
    return index.pages[level - 1] * ENTRY_MEMORY


def _steps(index: RectIndex, q: DataFrame, broadcast_bytes: int) -> Iterator[tuple[int, DataFrame]]:
    """(level, ``qid, q_*, page``): from the root's level down, the children that meet each query.

    Rectangles are dealt over pages, internal entries are few: levels within ``broadcast_bytes`` go to every task whole, beginning below the
    root, and queries stay where they are. Only a level beyond that, and the leaves, are joined by page; by then queries lie on many pages,
    so no key holds the whole batch."""
    at, meets = None, G.intersects(G.sides(), _query_sides())
    for level in range(index.height - 1, -1, -1):
        entries = index.entries.filter(F.col("level") == level).select("page", "child", *G.SIDES)
        if at is None:  # all queries begin at the root, whose entries all of them meet or not: one page, at most a page's entries
            at = q.join(F.broadcast(entries), meets)
        elif level and _level_bytes(index, level) <= broadcast_bytes:
            at = at.join(F.broadcast(entries), "page").filter(meets)
        else:
            at = at.join(entries, "page").filter(meets)
        at = at.drop("page", *G.SIDES).withColumnRenamed("child", "page")
        yield level, at


def descend(index: RectIndex, q: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``qid, child`` of the leaf entries that meet each query of ``q`` (qid and q_* sides), level by level."""
    for _, at in _steps(index, q, broadcast_bytes):
        pass
    return at.withColumnRenamed("page", "child")


def batch_stats(index: RectIndex, queries: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Statistics of each query of a batch: ``qid, pages_read, entries_tested, entries_pruned, results``."""
    q = _queries(queries)
    zero, read, results = F.lit(0).cast("long"), [], None
    for level, at in _steps(index, q, broadcast_bytes):
        # node counts of the pages that the step arrived at; pages are counted before they are looked up, once each
        if level:
            pages = at.groupBy("qid", "page").agg(F.count(F.lit(1)).alias("times"))
            nodes = index.nodes.filter(F.col("level") == level - 1).select("page", "node_count")
            nodes = F.broadcast(nodes) if index.pages[level - 1] * ENTRY_MEMORY <= broadcast_bytes else nodes
            read.append(pages.join(nodes, "page").groupBy("qid").agg(F.sum("times").alias("pages_read"), F.sum(F.col("times") * F.col("node_count")).alias("entries_tested")))
        else:
            results = at.groupBy("qid").agg(F.count(F.lit(1)).alias("results"))
    root = F.broadcast(index.nodes.filter(F.col("page") == index.root_page).select(F.lit(1).cast("long").alias("pages_read"), F.col("node_count").alias("entries_tested")))
    work = q.select("qid").join(root)  # one row
    for r in read:
        work = work.unionByName(r)
    work = work.groupBy("qid").agg(F.sum("pages_read").alias("pages_read"), F.sum("entries_tested").alias("entries_tested"))
    out = work.join(results, "qid", "left").withColumn("results", F.coalesce("results", zero))
    return out.select("qid", "pages_read", "entries_tested", (F.col("entries_tested") - F.col("pages_read") + 1 - F.col("results")).alias("entries_pruned"), "results")


def self_found(index: RectIndex, rects: DataFrame, found: bool = True) -> DataFrame:
    """Ids of ``rects`` whose own box finds (or, with ``found`` False, misses) them in the index: a semi or anti join on the id and the test."""
    own = rects.select("id", *(F.col(s).alias(f"q_{s}") for s in G.SIDES))
    leaves = index.entries.filter(LEAVES).select(F.col("child").alias("id"), *G.SIDES)
    on = (own["id"] == leaves["id"]) & G.intersects(G.sides(), _query_sides())
    return own.join(leaves, on, "left_semi" if found else "left_anti").select("id")
