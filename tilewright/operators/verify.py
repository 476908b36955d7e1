"""Structural audit of an index: every check as one row (check, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .build import RectIndex
from .query import LEAVES, SHOWN, batch_range_join

#: Source rectangles whose own query is tried.
SAMPLE = 1000


def duplicate_ids(index: RectIndex) -> DataFrame:
    """``id, n`` of objects that leaves hold more than once."""
    return index.entries.filter(LEAVES).groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_ids(index: RectIndex, n: int) -> DataFrame:
    """``id`` of 0..n-1 that no leaf holds."""
    leaves = index.entries.filter(LEAVES).select(F.col("child").alias("id"))
    return index.entries.sparkSession.range(n).join(leaves, "id", "left_anti")


def page_counts(index: RectIndex) -> DataFrame:
    return index.nodes.groupBy((F.col("level") == 0).alias("is_leaf")).agg(F.count(F.lit(1)).alias("pages"), F.sum("node_count").alias("entries"))


def occupancy(index: RectIndex) -> DataFrame:
    """Percent of the leaves' slots that are used."""
    leaves = index.nodes.filter(F.col("level") == 0).agg(F.sum("node_count").alias("n"), F.count(F.lit(1)).alias("pages"))
    return leaves.join(F.broadcast(index.meta.select("leaf_cap")), F.lit(True)).select((F.col("n") * 100.0 / (F.col("pages") * F.col("leaf_cap"))).alias("occupancy_pct"))


def linked_pages(index: RectIndex) -> DataFrame:
    """One row for each page that exists or that an internal entry points to: ``page, level`` (null: it does not exist), its own box and
    ``node_count``, ``parents``, and of its parents the levels and the least and greatest of each stored side.

    A sound tree is this table: the root alone has no parent, every other page has one, a level above its own. By induction from the
    leaves up that is what a walk from the root visits, without walking."""
    sides = [c for s in G.SIDES for c in (F.min(s).alias(f"least_{s}"), F.max(s).alias(f"most_{s}"))]
    parents = index.entries.filter(F.col("level") > 0).groupBy(F.col("child").alias("page")).agg(F.count(F.lit(1)).alias("parents"), F.min("level").alias("parent_level"), F.max("level").alias("parent_level_most"), *sides)
    own = index.entries.groupBy("page").agg(F.min("level").alias("level"), F.max("level").alias("level_most"), F.count(F.lit(1)).alias("node_count"), *G.union_of())
    return own.join(parents, "page", "full").withColumn("parents", F.coalesce("parents", F.lit(0).cast("long")))


#: The checks in the order of a report, and what each says.
CHECKS = {
    "page_id_in_range": "pages and child pointers lie in 1..num_nodes of the header",
    "page_exists": "every child pointer leads to a page",
    "page_reached": "every page but the root has a parent",
    "page_reached_once": "no page has two parents, nor the root any",
    "page_not_empty": "every listed page holds an entry",
    "page_within_capacity": "no page holds more entries than its level's capacity",
    "parent_contains_children": "a stored box contains its page's entries",
    "parent_is_union_of_children": "a stored box is their least box",
    "leaves_at_one_depth": "a page lies one level below its parent, and on one level",
    "root_contains_tree": "the header's box contains the root's entries",
    "node_count_as_stated": "pages and the header's num_nodes agree",
    "height_as_stated": "the root's level and the header's height agree",
    "object_id_in_range": "object ids lie in 0..num_rects - 1",
    "object_id_once": "no object id is held twice",
    "no_object_missing": "every object id is held",
    "leaf_equals_source": "leaf boxes are those of the source",
    "source_rows_as_stated": "the source has num_rects rows",
    "source_id_is_ordinal": "ids of the source are its rows' ordinals",
    "sampled_rect_found": "a query through the tree with a rectangle's own box finds it",
}


def _page_faults(index: RectIndex) -> dict[str, Column]:
    """Of a row of ``linked_pages`` joined with the header: what each check counts."""
    exists, root = F.col("level").isNotNull(), F.col("page") == F.col("root_page")
    cap = F.when(F.col("level") == 0, F.col("leaf_cap")).otherwise(F.col("internal_cap"))
    least, most, own = [F.col(f"least_{s}") for s in G.SIDES], [F.col(f"most_{s}") for s in G.SIDES], G.sides()
    tightest = [most[0], most[1], least[2], least[3]]  # what all of its parents' boxes contain
    held = exists & (F.col("parents") > 0)
    unequal = F.lit(False)
    for lo, hi, o in zip(least, most, own, strict=True):
        unequal = unequal | (lo != o) | (hi != o)
    return {
        "page_id_in_range": (F.col("page") < 1) | (F.col("page") > F.col("num_nodes")),
        "page_exists": ~exists,
        "page_reached": exists & ~root & (F.col("parents") == 0),
        "page_reached_once": F.col("parents") > F.when(root, 0).otherwise(1),
        "page_within_capacity": exists & (F.col("node_count") > cap),
        "parent_contains_children": held & ~G.contains(tightest, own),
        "parent_is_union_of_children": held & unequal,
        "leaves_at_one_depth": (exists & (F.col("level") != F.col("level_most"))) | (held & ((F.col("parent_level") != F.col("level") + 1) | (F.col("parent_level_most") != F.col("parent_level")))),
        "root_contains_tree": exists & root & ~G.contains([F.col(f"root_{s}") for s in G.SIDES], own),
        "height_as_stated": root & ~F.coalesce(F.col("level") + 1 == F.col("height"), F.lit(False)),
    }


def faulty_pages(index: RectIndex, check: str) -> DataFrame:
    """Rows of ``linked_pages`` that violate a check."""
    pages = linked_pages(index).join(F.broadcast(index.meta), F.lit(True))
    return pages.filter(F.coalesce(_page_faults(index)[check], F.lit(False))).drop(*index.meta.columns)


def _leaf_faults(index: RectIndex, rects: DataFrame | None) -> tuple[DataFrame, dict[str, Column]]:
    """One row for each object id of 0..num_rects - 1, of the leaves, or of the source; and what each check counts of it."""
    n = index.meta.select("num_rects").first()[0]
    boxes = lambda p: [F.min(s).alias(f"{p}_{s}") for s in G.SIDES]
    leaves = index.entries.filter(LEAVES).groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("times"), *boxes("leaf"))
    rows = leaves.join(index.entries.sparkSession.range(n).withColumn("stated", F.lit(True)), "id", "full")
    stated, times = F.col("stated").isNotNull(), F.coalesce("times", F.lit(0))
    faults = {"object_id_in_range": ~stated, "object_id_once": times > 1, "no_object_missing": stated & (times == 0)}
    if rects is not None:
        source = G.checked(rects).groupBy("id").agg(F.count(F.lit(1)).alias("rows"), *boxes("source"))
        rows = rows.join(source, "id", "full")
        unequal = F.lit(False)
        for s in G.SIDES:
            unequal = unequal | (F.col(f"leaf_{s}") != F.col(f"source_{s}"))
        faults |= {"leaf_equals_source": unequal, "source_id_is_ordinal": (F.col("rows").isNotNull() & ~stated) | (F.coalesce("rows", F.lit(1)) > 1)}
    return rows, faults


def faulty_objects(index: RectIndex, check: str, rects: DataFrame | None = None) -> DataFrame:
    """Object ids that violate a check."""
    rows, faults = _leaf_faults(index, rects)
    return rows.filter(F.coalesce(faults[check], F.lit(False)))


def verify(index: RectIndex, rects: DataFrame | None = None) -> DataFrame:
    """``check, violations`` for the structure of the index, and against its source where ``rects`` (id, box) is given; ``CHECKS`` says what
    each means.

    The entries are read twice: once by page, for all checks of pages and links, and once by object."""
    counted = lambda faults: [F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in faults.items()]
    unpivoted = lambda row, names: row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("violations")) for c in names])).alias("c")).select("c.*")
    faults = _page_faults(index)
    pages = linked_pages(index).join(F.broadcast(index.meta), F.lit(True))
    row = pages.agg(*counted(faults), F.count("level").alias("found"))
    row = row.join(F.broadcast(index.meta.select("num_nodes")), F.lit(True)).withColumn("node_count_as_stated", F.abs(F.col("found") - F.col("num_nodes")))
    empty = index.nodes.filter("node_count < 1").select("page").unionByName(index.nodes.select("page").join(index.entries.select("page"), "page", "left_anti")).distinct()
    row = row.join(F.broadcast(empty.agg(F.count(F.lit(1)).alias("page_not_empty"))), F.lit(True))
    parts = [unpivoted(row, [*faults, "node_count_as_stated", "page_not_empty"])]
    rows, faults = _leaf_faults(index, rects)
    row = rows.agg(*counted(faults), *([F.sum("rows").alias("rows")] if rects is not None else []))
    names = list(faults)
    if rects is not None:
        n = index.meta.select("num_rects").first()[0]
        row = row.withColumn("source_rows_as_stated", F.abs(F.coalesce("rows", F.lit(0)) - F.lit(n)))
        sampled = rects.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0)
        missed = not_found(index, sampled).agg(F.count(F.lit(1)).alias("violations")).select(F.lit("sampled_rect_found").alias("check"), "violations")
        parts += [unpivoted(row, [*names, "source_rows_as_stated"]), missed]
    else:
        parts.append(unpivoted(row, names))
    return reduce(DataFrame.unionByName, parts)


def not_found(index: RectIndex, rects: DataFrame) -> DataFrame:
    """``id`` of ``rects`` that a query through the tree with their own box does not find."""
    hits = batch_range_join(index, rects.withColumnRenamed("id", "qid"), broadcast_queries=0)
    return rects.select("id").join(hits.filter("qid = id").select("id"), "id", "left_anti")


def samples(index: RectIndex, rects: DataFrame | None = None, most: int = SHOWN) -> DataFrame:
    """``check, page_or_id``: the first ``most`` violations of each check by page or object id, as a report shows them; counts go on beyond."""
    pages = linked_pages(index).join(F.broadcast(index.meta), F.lit(True))
    rows, faults = _leaf_faults(index, rects)

    def named(df: DataFrame, key: str, faults: dict[str, Column]) -> DataFrame:
        hit = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in faults.items()]))
        return df.select(F.explode(hit).alias("check"), F.col(key).alias("page_or_id"))

    # a page and an object are one row each; every task passes on the first of its own alone (a group limit before the exchange)
    found = named(pages, "page", _page_faults(index)).unionByName(named(rows, "id", faults))
    place = F.row_number().over(Window.partitionBy("check").orderBy("page_or_id"))
    return found.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def merge_check(index: RectIndex) -> DataFrame:
    """Leaves in page and slot order: rows, id checksum, and slots of a page whose y key steps back."""
    w = Window.partitionBy("page").orderBy("slot")
    leaves = index.entries.filter(LEAVES).withColumn("key", G.key_y())
    steps = leaves.withColumn("before", F.lag("key").over(w))
    return steps.agg(F.count(F.lit(1)).alias("n"), F.sum("child").alias("id_sum"), F.count_if(F.col("before") > F.col("key")).alias("out_of_order"))
