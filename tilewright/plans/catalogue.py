"""The registered queries and their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import shape
from ..operators import bench, build, query, rank, verify
from ..sources import binary, generate, store
from ..sources.scratch import new_folder
from .views import EVENTS_SQL, ORDERS_SQL, PART_SQL, rects_events, rects_orders, rects_part, tree_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CAP = shape.MAX_ENTRIES
BOX, EDGE, ALL, EMPTY, INVERTED = (100.0, 500.0, 200.0, 700.0), (0.0, 500.0, 1000.0, 500.0), (-1e6, -1e6, 1e6, 1e6), (5000.0, 0.0, 6000.0, 10.0), (200.0, 700.0, 100.0, 500.0)
POINT = (295.8462, 1703.5)
#: Boxes of the batch queries, by qid.
BATCH = ((100.0, 100.0, 200.0, 200.0), (0.0, 0.0, 1010.0, 1010.0), (500.0, 500.0, 505.0, 505.0), (12.5, 900.25, 33.75, 950.5), (120.1, -300.2, 140.3, 12.3), (300.0, 10.0, 200.0, 400.0))
#: Where the trials of the registered sweep lie.
CORNERS = tuple(((k * 37 % 100) / 100, (k * 61 % 100) / 100) for k in range(20))
SIDES = ", ".join(G.SIDES)
TREE = tree_ctes(ORDERS_SQL, CAP, CAP)
DEEP = tree_ctes(EVENTS_SQL, 8, 8, 7)


def registered(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def sql_box(box: G.Box, a: str = "") -> str:
    f = lambda v: f"CAST({v!r} AS FLOAT)"
    return f"{a}min_x <= {f(box[2])} AND {a}max_x >= {f(box[0])} AND {a}min_y <= {f(box[3])} AND {a}max_y >= {f(box[1])}"


def sql_point(x: float, y: float) -> str:
    return f"min_x <= CAST({x} AS FLOAT) AND max_x >= CAST({x} AS FLOAT) AND min_y <= CAST({y} AS FLOAT) AND max_y >= CAST({y} AS FLOAT)"


def sql_values(boxes) -> str:
    return "queries(qid, qx0, qy0, qx1, qy1) AS (VALUES " + ", ".join(f"(CAST({k} AS BIGINT), " + ", ".join(f"CAST({v!r} AS FLOAT)" for v in b) + ")" for k, b in enumerate(boxes)) + ")"


MEETS = "e.min_x <= qx1 AND e.max_x >= qx0 AND e.min_y <= qy1 AND e.max_y >= qy0"
R = f"WITH rects AS ({ORDERS_SQL}) "


def packed(spark: SparkSession, sf_dir: str, **options) -> build.RectIndex:
    """A tree over the orders, packed anew."""
    return build.build_index(rects_orders(spark, sf_dir), **options)


_stored: dict[tuple[str, str], str] = {}


def orders_index(spark: SparkSession, sf_dir: str) -> build.RectIndex:
    """The tree over the orders as a stored index, which queries open: packed and stored when the session first asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = new_folder(spark, "orders-index")
        with packed(spark, sf_dir) as index:
            store.save_index(index, path)
        _stored[key] = path
    return store.load_index(spark, _stored[key])


def batch(spark: SparkSession, boxes=BATCH) -> DataFrame:
    return spark.createDataFrame([(k, *b) for k, b in enumerate(boxes)], "qid long, min_x float, min_y float, max_x float, max_y float")


# Scans and expressions
registered("scan_rects", f"{R} SELECT id, {SIDES} FROM rects")(lambda s, d: G.checked(rects_orders(s, d)))
registered("scan_events", f"WITH rects AS ({EVENTS_SQL}) SELECT id, {SIDES} FROM rects")(lambda s, d: G.checked(rects_events(s, d)))
registered("scan_points", f"WITH rects AS ({PART_SQL}) SELECT id, {SIDES} FROM rects")(lambda s, d: G.checked(rects_part(s, d)))
registered("centroid_keys", f"{R} SELECT id, min_x + max_x AS kx, min_y + max_y AS ky FROM rects")(lambda s, d: rects_orders(s, d).select("id", G.key_x().alias("kx"), G.key_y().alias("ky")))
registered("mbr_union", f"{R} SELECT min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM rects")(lambda s, d: rects_orders(s, d).agg(*G.union_of()))
registered("mbr_union_by_group", f"{R} SELECT id % 10 AS g, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM rects GROUP BY 1")(
    lambda s, d: rects_orders(s, d).groupBy((F.col("id") % 10).alias("g")).agg(*G.union_of())
)

# Queries through the index
for _name, _box in (("range_query", BOX), ("range_touching_edge", EDGE), ("range_all", ALL), ("range_empty", EMPTY), ("range_inverted", INVERTED)):
    registered(_name, f"{R} SELECT id, {SIDES} FROM rects WHERE {sql_box(_box)}")(lambda s, d, box=_box: query.range_query(orders_index(s, d), box))
registered("range_points", f"WITH rects AS ({PART_SQL}) SELECT id, {SIDES} FROM rects WHERE {sql_box((905.0, 7.0, 1005.0, 21.0))}")(lambda s, d: query.range_query(build.build_index(rects_part(s, d)), (905.0, 7.0, 1005.0, 21.0)))
registered("range_count", f"{R} SELECT count(*) AS n FROM rects WHERE {sql_box(BOX)}")(lambda s, d: query.range_count(orders_index(s, d), BOX))
registered("range_limit20", f"{R} SELECT id, {SIDES} FROM rects WHERE {sql_box(BOX)} ORDER BY id LIMIT 20")(lambda s, d: query.first_hits(query.range_query(orders_index(s, d), BOX)))
registered("point_query", f"{R} SELECT id, {SIDES} FROM rects WHERE {sql_point(*POINT)}")(lambda s, d: query.point_query(orders_index(s, d), *POINT))
registered("point_count", f"{R} SELECT count(*) AS n FROM rects WHERE {sql_point(*POINT)}")(lambda s, d: query.point_count(orders_index(s, d), *POINT))
registered("contains_query", f"{R} SELECT id, {SIDES} FROM rects WHERE min_x >= CAST(100 AS FLOAT) AND min_y >= CAST(500 AS FLOAT) AND max_x <= CAST(200 AS FLOAT) AND max_y <= CAST(700 AS FLOAT)")(
    lambda s, d: query.contained_query(orders_index(s, d), BOX)
)

# Packing
registered("str_x_rank", f"{R} SELECT id, row_number() OVER (ORDER BY min_x + max_x, id) - 1 AS rank_x FROM rects")(
    lambda s, d: rank.global_rank(rects_orders(s, d), [G.key_x(), F.col("id")], "rank_x", rects_orders(s, d).count()).select("id", "rank_x")
)
registered("str_x_rank_partitioned", ORACLES["str_x_rank"])(lambda s, d: rank.global_rank(rects_orders(s, d), [G.key_x(), F.col("id")], "rank_x", 1, one_task_rows=0).select("id", "rank_x"))
registered("str_slices", f"{TREE} SELECT slice, count(*) AS n, min(rank_x) AS first_rank, min(min_x + max_x) AS least_key FROM t0 GROUP BY slice")(
    lambda s, d: _ranked(s, d).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.min("rank_x").alias("first_rank"), F.min(G.key_x()).alias("least_key"))
)
registered("str_leaf_assignment", f"{TREE} SELECT child AS id, page, slot FROM e0")(lambda s, d: packed(s, d).entries.filter("is_leaf").select(F.col("child").alias("id"), "page", "slot"))
registered("str_leaf_nodes", f"{TREE} SELECT page, node_count, {SIDES} FROM n0")(lambda s, d: packed(s, d).nodes.filter("level = 0").select("page", "node_count", *G.SIDES))
registered("str_level1_nodes", f"{TREE} SELECT page, node_count, {SIDES} FROM n1")(lambda s, d: packed(s, d).nodes.filter("level = 1").select("page", "node_count", *G.SIDES))
registered("str_tree_entries", f"{TREE} SELECT * FROM entries")(lambda s, d: packed(s, d).entries)
registered("str_tree_partitioned", ORACLES["str_tree_entries"])(lambda s, d: packed(s, d, one_task_rows=1).entries)
registered("str_deep_tree", f"{DEEP} SELECT * FROM entries")(lambda s, d: build.build_index(rects_events(s, d), leaf_cap=8, internal_cap=8).entries)
registered("tree_meta", f"""{TREE} SELECT CAST(4096 AS BIGINT) AS page_bytes, (SELECT count(DISTINCT level) FROM nodes) AS height, CAST({CAP} AS BIGINT) AS max_entries_per_page, CAST({CAP} AS BIGINT) AS leaf_cap,
  CAST({CAP} AS BIGINT) AS internal_cap, (SELECT count(*) FROM rects) AS num_rects, (SELECT count(*) FROM nodes) AS num_nodes, (SELECT count(*) FROM nodes) AS root_page, CAST(1 AS FLOAT) AS fill_leaf,
  CAST(1 AS FLOAT) AS fill_internal, min(min_x) AS root_min_x, min(min_y) AS root_min_y, max(max_x) AS root_max_x, max(max_y) AS root_max_y FROM rects""")(lambda s, d: packed(s, d).meta)  # fmt: skip
for _percent, _leaf, _internal in ((100, 1.0, 1.0), (70, 0.7, 0.7), (50, 0.5, 1.0), (25, 0.25, 0.25)):
    _lc, _ic = shape.capacity(_leaf), shape.capacity(_internal)
    registered(f"tree_shape_fill_{_percent:03d}", f"{tree_ctes(ORDERS_SQL, _lc, _ic)} SELECT level, count(*) AS pages, count(*) AS expected FROM nodes GROUP BY level")(
        lambda s, d, a=_leaf, b=_internal: build.checked_shape(packed(s, d, fill_leaf=a, fill_internal=b)).select("level", "pages", "expected")
    )
registered("leaf_pages", f"{TREE} SELECT page FROM n0")(lambda s, d: query.leaf_pages(orders_index(s, d)))
registered("internal_pages", f"{TREE} SELECT page FROM nodes WHERE level > 0")(lambda s, d: query.internal_pages(orders_index(s, d)))
registered("page_entries", f"{TREE} SELECT * FROM entries WHERE page = 3")(lambda s, d: query.page_entries(orders_index(s, d), 3))


def _ranked(s: SparkSession, d: str) -> DataFrame:
    rects = rects_orders(s, d)
    return build.str_ranked(rects.withColumnRenamed("id", "child"), rects.count(), CAP)


# Work statistics
def _stats_sql(meets: str) -> str:
    return f"""{TREE}, visited AS (SELECT child AS page FROM entries e WHERE NOT is_leaf AND {meets} UNION ALL SELECT max(page) FROM nodes),
x AS (SELECT (SELECT count(*) FROM visited) AS pages_read, CAST((SELECT sum(node_count) FROM nodes JOIN visited USING (page)) AS BIGINT) AS entries_tested, (SELECT count(*) FROM rects e WHERE {meets}) AS results)
SELECT pages_read, entries_tested, entries_tested - (pages_read - 1) - results AS entries_pruned, results FROM x"""


registered("range_stats", _stats_sql(sql_box(BOX)))(lambda s, d: query.range_stats(orders_index(s, d), BOX))
registered("range_stats_miss", _stats_sql(sql_box(EMPTY)))(lambda s, d: query.range_stats(orders_index(s, d), EMPTY))
registered("point_stats", _stats_sql(sql_point(*POINT)))(lambda s, d: query.point_stats(orders_index(s, d), *POINT))

# Batches and joins
_JOIN = f"{R}, {sql_values(BATCH)} SELECT qid, id FROM rects e, queries WHERE {MEETS}"
registered("batch_range_join", _JOIN)(lambda s, d: query.batch_range_join(orders_index(s, d), batch(s)))
registered("batch_range_descend", _JOIN)(lambda s, d: query.batch_range_join(orders_index(s, d), batch(s), broadcast_queries=0))
_BATCH_STATS = f"""{TREE}, {{values}}, visited AS (SELECT qid, child AS page FROM entries e, queries WHERE NOT is_leaf AND {MEETS} UNION ALL SELECT qid, (SELECT max(page) FROM nodes) FROM queries),
w AS (SELECT qid, count(*) AS pages_read, CAST(sum(node_count) AS BIGINT) AS entries_tested FROM visited JOIN nodes USING (page) GROUP BY qid),
h AS (SELECT qid, count(*) AS results FROM rects e, queries WHERE {MEETS} GROUP BY qid),
stats AS (SELECT qid, pages_read, entries_tested, entries_tested - pages_read + 1 - coalesce(results, 0) AS entries_pruned, coalesce(results, 0) AS results FROM w LEFT JOIN h USING (qid))"""
registered("batch_stats", _BATCH_STATS.format(values=sql_values(BATCH)) + " SELECT * FROM stats")(lambda s, d: query.batch_stats(orders_index(s, d), batch(s)))
registered("tree_self_found", f"{R} SELECT id FROM rects WHERE false")(lambda s, d: verify.not_found(orders_index(s, d), rects_orders(s, d)))
registered("spatial_self_semi", f"{R} SELECT id FROM rects")(lambda s, d: query.self_found(orders_index(s, d), rects_orders(s, d)))
registered("spatial_anti", f"{R} SELECT id FROM rects WHERE false")(lambda s, d: query.self_found(orders_index(s, d), rects_orders(s, d), found=False))
registered("spatial_join_parts", f"WITH a AS ({EVENTS_SQL}), e AS ({ORDERS_SQL}) SELECT a.id AS qid, e.id FROM a JOIN e ON e.min_x <= a.max_x AND e.max_x >= a.min_x AND e.min_y <= a.max_y AND e.max_y >= a.min_y")(
    lambda s, d: query.batch_range_join(orders_index(s, d), rects_events(s, d).withColumnRenamed("id", "qid"), broadcast_queries=0)
)

# Audit
def sql_checks(found: dict[str, int]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST({found.get(c, 0)} AS BIGINT))" for c in verify.CHECKS) + ') AS v("check", violations)'


registered("verify_checks", sql_checks({}))(lambda s, d: verify.verify(orders_index(s, d), rects_orders(s, d)))


def changed(index: build.RectIndex, change) -> build.RectIndex:
    """``index`` with other entries."""
    return build.RectIndex(change(index.entries), index.nodes, index.meta, index.pages, index.root_page)


def _dangling(e: DataFrame) -> DataFrame:
    """Leaf page 2 gets a second parent entry in place of that of leaf page 3, which nothing leads to; page 4's goes beyond all pages."""
    child = F.when((F.col("level") == 1) & (F.col("child") == 3), 2).when((F.col("level") == 1) & (F.col("child") == 4), 1_000_000_000).otherwise(F.col("child"))
    return e.withColumn("child", child.cast("long"))


# The faults that one change makes, in an index of any size: two pages unreached, one reached twice, one pointer out of range.
registered("verify_dangling", """SELECT * FROM (VALUES ('page_id_in_range', CAST(1 AS BIGINT)), ('page_exists', CAST(1 AS BIGINT)), ('page_reached', CAST(2 AS BIGINT)), ('page_reached_once', CAST(1 AS BIGINT))) AS v("check", violations)""")(
    lambda s, d: verify.verify(changed(orders_index(s, d), _dangling)).filter(F.col("check").isin("page_id_in_range", "page_exists", "page_reached", "page_reached_once"))
)
registered("verify_dangling_samples", "SELECT * FROM (VALUES ('page_exists', CAST(1000000000 AS BIGINT)), ('page_reached', CAST(3 AS BIGINT)), ('page_reached', CAST(4 AS BIGINT)), ('page_reached_once', CAST(2 AS BIGINT))) AS v(\"check\", page_or_id)")(
    lambda s, d: verify.samples(changed(orders_index(s, d), _dangling)).filter(F.col("check").isin("page_exists", "page_reached", "page_reached_once"))
)
registered("verify_header", f"""{R} SELECT * FROM (VALUES ('node_count_as_stated', CAST(3 AS BIGINT)), ('height_as_stated', CAST(1 AS BIGINT)), ('root_contains_tree', CAST(1 AS BIGINT))) AS v("check", violations)
UNION ALL SELECT 'no_object_missing', CAST(5 AS BIGINT) UNION ALL SELECT 'page_within_capacity', CAST(count(*) AS BIGINT) FROM (SELECT page FROM ({TREE} SELECT page, node_count FROM n0) WHERE node_count > 169)""")(lambda s, d: _stated(s, d))
registered("verify_source", f"""{R} SELECT 'leaf_equals_source' AS "check", CAST(count(*) AS BIGINT) AS violations FROM rects WHERE id % 50 = 3 UNION ALL SELECT 'source_id_is_ordinal', CAST(count(*) AS BIGINT) FROM rects WHERE id % 100 = 7
UNION ALL SELECT 'source_rows_as_stated', CAST(count(*) AS BIGINT) FROM rects WHERE id % 100 = 7""")(lambda s, d: _other_source(s, d))


def _stated(s: SparkSession, d: str) -> DataFrame:
    """A header that states three pages, a level, five objects more, one leaf slot less and a smaller box."""
    index = orders_index(s, d)
    meta = index.meta.withColumns({"num_nodes": F.col("num_nodes") + 3, "height": F.col("height") + 1, "num_rects": F.col("num_rects") + 5, "leaf_cap": F.col("leaf_cap") - 1, "root_max_x": F.col("root_max_x") - 1})
    found = verify.verify(build.RectIndex(index.entries, index.nodes, meta, index.pages, index.root_page))
    return found.filter(F.col("check").isin("node_count_as_stated", "height_as_stated", "root_contains_tree", "no_object_missing", "page_within_capacity"))


def _other_source(s: SparkSession, d: str) -> DataFrame:
    """A source with moved boxes, and with rows that repeat an id."""
    moved = rects_orders(s, d).withColumn("max_y", F.when(F.col("id") % 50 == 3, F.col("max_y") + F.lit(1.0).cast("float")).otherwise(F.col("max_y")))
    found = verify.verify(orders_index(s, d), moved.unionByName(moved.filter("id % 100 = 7")))
    return found.filter(F.col("check").isin("leaf_equals_source", "source_id_is_ordinal", "source_rows_as_stated"))


registered("missing_ids", f"{R} SELECT range AS id FROM range((SELECT max(id) + 1 FROM rects)) WHERE range NOT IN (SELECT id FROM rects WHERE id % 100 <> 7)")(
    lambda s, d: verify.missing_ids(_with_gaps(s, d), rects_orders(s, d).agg(F.max("id")).first()[0] + 1)
)
registered("duplicate_ids", f"{R} SELECT id, CAST(2 AS BIGINT) AS n FROM rects WHERE id % 100 = 7")(lambda s, d: verify.duplicate_ids(_with_copies(s, d)))
registered("occupancy", f"{TREE} SELECT CAST(sum(node_count) AS DOUBLE) * 100 / (count(*) * {CAP}) AS occupancy_pct FROM n0")(lambda s, d: verify.occupancy(orders_index(s, d)))
registered("page_counts", f"{TREE} SELECT level = 0 AS is_leaf, count(*) AS pages, CAST(sum(node_count) AS BIGINT) AS entries FROM nodes GROUP BY 1")(lambda s, d: verify.page_counts(orders_index(s, d)))
registered("merge_sortedness", f"{R} SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum, CAST(0 AS BIGINT) AS out_of_order FROM rects")(lambda s, d: verify.merge_check(orders_index(s, d)))


def _with_gaps(s: SparkSession, d: str) -> build.RectIndex:
    return build.build_index(rects_orders(s, d).filter("id % 100 <> 7"))


def _with_copies(s: SparkSession, d: str) -> build.RectIndex:
    rects = rects_orders(s, d)
    return build.build_index(rects.unionByName(rects.filter("id % 100 = 7")))


# Sweeps
registered("bruteforce_equivalence", f"{R}, {sql_values(BATCH)} SELECT qid, count(id) AS index_hits, count(id) AS scan_hits FROM queries LEFT JOIN rects e ON {MEETS} GROUP BY qid")(
    lambda s, d: bench.equivalence(orders_index(s, d), rects_orders(s, d), batch(s))
)
_TRIALS = f"""corners(qid, u, v) AS (VALUES {", ".join(f"(CAST({k} AS BIGINT), CAST({u!r} AS DOUBLE), CAST({v!r} AS DOUBLE))" for k, (u, v) in enumerate(CORNERS))}),
root AS (SELECT CAST(min(min_x) AS DOUBLE) AS x0, CAST(min(min_y) AS DOUBLE) AS y0, CAST(max(max_x) AS DOUBLE) AS x1, CAST(max(max_y) AS DOUBLE) AS y1 FROM rects),
sides AS (SELECT *, (x1 - x0) * sqrt(CAST(1 AS DOUBLE) / 100) AS w, (y1 - y0) * sqrt(CAST(1 AS DOUBLE) / 100) AS h FROM root),
low AS (SELECT qid, x0 + u * (x1 - x0 - w) AS x, y0 + v * (y1 - y0 - h) AS y, w, h FROM corners, sides),
queries AS (SELECT qid, CAST(x AS FLOAT) AS qx0, CAST(y AS FLOAT) AS qy0, CAST(x + w AS FLOAT) AS qx1, CAST(y + h AS FLOAT) AS qy1 FROM low)"""
registered("bench_selectivity", _BATCH_STATS.format(values=_TRIALS) + """ SELECT avg(results) AS avg_hits, avg(pages_read) AS avg_pages, avg(pages_read) * 4096 / 1024 AS avg_kb,
  CAST(sum(entries_pruned) AS DOUBLE) * 100 / CAST(sum(entries_tested) AS DOUBLE) AS pruned_pct, CAST(sum(entries_tested) AS DOUBLE) / CAST(sum(pages_read) AS DOUBLE) AS tests_per_page FROM stats""")(
    lambda s, d: bench.sweep(orders_index(s, d), 1.0, at=CORNERS)
)

# Generators and binary forms
GENERATED = 10_000


def sql_draw(key: str, name: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:{name}:' || {key}), 1, {generate.DIGITS}) AS BIGINT)"


def sql_uniform(key: str, name: str, seed: int) -> str:
    return f"{sql_draw(key, name, seed)} * CAST({2.0 ** (-4 * generate.DIGITS)!r} AS DOUBLE)"


def sql_generated(x: str, y: str, least: float, most: float, seed: int) -> str:
    side = lambda name: f"CAST({least!r} + {sql_uniform('id', name, seed)} * CAST({most - least!r} AS DOUBLE) AS FLOAT)"
    return f"""WITH c AS (SELECT range AS id FROM range({GENERATED})), p AS (SELECT id, CAST({x} AS FLOAT) AS min_x, CAST({y} AS FLOAT) AS min_y, {side("w")} AS w, {side("h")} AS h FROM c)
SELECT id, min_x, min_y, min_x + w AS max_x, min_y + h AS max_y FROM p"""


def _generated_sql(least: float, most: float, seed: int) -> str:
    x, y = (f"{sql_uniform('id', c, seed)} * CAST({generate.EXTENT!r} AS DOUBLE)" for c in "xy")
    return sql_generated(x, y, least, most, seed)


def _clustered_sql(clusters: int) -> str:
    seed, extent = generate.SEED, generate.EXTENT
    cluster = f"({sql_draw('id', 'cluster', seed)} % {clusters})"
    radius = f"sqrt(-2 * ln(1 - {sql_uniform('id', 'r', seed)})) * CAST({extent / 100!r} AS DOUBLE)"
    angle = f"({sql_uniform('id', 'a', seed)} * CAST({2 * math.pi!r} AS DOUBLE))"
    corner = lambda axis, f: f"greatest(0.0, least(CAST({extent!r} AS DOUBLE), {sql_uniform(cluster, 'centre-' + axis, seed)} * CAST({extent!r} AS DOUBLE) + {radius} * {f}({angle})))"
    return sql_generated(corner("x", "cos"), corner("y", "sin"), generate.LEAST, generate.MOST, seed)


registered("generate_uniform", _generated_sql(generate.LEAST, generate.MOST, generate.SEED))(lambda s, d: generate.uniform_rects(s, GENERATED))
registered("generate_clustered", _clustered_sql(50))(lambda s, d: generate.clustered_rects(s, GENERATED, 50))
registered("generate_unit_squares", _generated_sql(1.0, 1.0, 11))(lambda s, d: generate.unit_squares(s, GENERATED))


@registered("binary_roundtrip", f"{R} SELECT id, {SIDES} FROM rects")
def binary_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "rects").removeprefix("file:")
    binary.write_rects(rects_orders(s, d), path)
    return binary.read_rects(s, path)


@registered("tree_roundtrip", f"{TREE} SELECT * FROM entries")
def tree_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "tree").removeprefix("file:")
    with packed(s, d) as index:
        binary.write_tree(index, path)
    return binary.read_tree(s, path).entries


@registered("stored_index_query", f"{R} SELECT id, {SIDES} FROM rects WHERE {sql_box(BOX)}")
def stored_index_query(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "index")
    with packed(s, d) as index:
        store.save_index(index, path)
    return query.range_query(store.load_index(s, path), BOX)
