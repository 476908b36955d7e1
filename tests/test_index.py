import os
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.operators import bench, build, query, verify
from tilewright.sources import generate

from . import oracle


def made(n, seed, kind="mixed"):
    rng, out = random.Random(seed), {}
    for i in range(n):
        x, y = (rng.randint(-5, 5), rng.randint(-5, 5)) if kind == "ties" else (rng.uniform(-100, 100), rng.uniform(-100, 100))
        w, h = rng.choice([(0, 0), (rng.uniform(0, 9), rng.uniform(0, 9))])
        out[i] = tuple(map(G.f32, (x, y, x + w, y + h)))
    return out


def frame(spark, rects):
    return spark.createDataFrame([(i, *b) for i, b in rects.items()], "id long, min_x float, min_y float, max_x float, max_y float").repartition(3)


def as_tree(index):
    out = {}
    for e in index.entries.orderBy("page", "slot").collect():
        out.setdefault(e["page"], (e["level"], []))[1].append((tuple(e[s] for s in G.SIDES), e["child"]))
    return out


CASES = [(1, 5, 5, 10**6), (5, 5, 5, 10**6), (6, 5, 5, 10**6), (60, 5, 5, 10**6), (211, 4, 3, 10**6), (97, 2, 2, 10**6), (300, 7, 5, 1)]


@pytest.mark.parametrize(("n", "leaf", "internal", "one_task"), CASES)
@pytest.mark.parametrize("kind", ["mixed", "ties"])
def test_pages_equal_sequential_packing(spark, n, leaf, internal, one_task, kind):
    rects = made(n, n, kind)
    index = build.build_index(frame(spark, rects), leaf_cap=leaf, internal_cap=internal, one_task_rows=one_task)
    tree, root = oracle.build(rects, leaf, internal)
    assert as_tree(index) == tree and index.root_page == root


def test_equal_keys(spark):
    rects = {i: (1.0, 1.0, 2.0, 2.0) for i in range(40)}
    assert as_tree(build.build_index(frame(spark, rects), leaf_cap=4, internal_cap=4)) == oracle.build(rects, 4, 4)[0]


BOXES = [(-20, -20, 20, 20), (-1e6, -1e6, 1e6, 1e6), (0.1, 0.1, 12.3, 12.3), (500, 500, 505, 505), (20, 20, -20, -20), (-3, -3, -3, -3), (float("nan"), 0, 1, 1)]


def test_answers_and_statistics_equal_a_descent(spark):
    rects = made(250, 8) | {250 + k: tuple(map(G.f32, b)) for k, b in enumerate([(0.0, 0.0, 0.1, 0.1), (0.1, 0.1, 0.1, 0.1)])}
    index = build.build_index(frame(spark, rects), leaf_cap=6, internal_cap=4)
    tree, root = oracle.build(rects, 6, 4)
    for box in BOXES:
        b = tuple(map(G.f32, box))
        hits, stats = oracle.descend(tree, root, b)
        found = query.range_query(index, box)
        assert sorted(r["id"] for r in found.collect()) == hits == sorted(i for i, r in rects.items() if oracle.meets(r, b))
        assert tuple(query.range_stats(index, box).first()) == stats
        assert query.range_count(index, box).first()[0] == len(hits)
        x, y = box[:2]
        hits, stats = oracle.descend(tree, root, (b[0], b[1], b[0], b[1]))
        assert sorted(r["id"] for r in query.point_query(index, x, y).collect()) == hits
        assert tuple(query.point_stats(index, x, y).first()) == stats
    q = spark.createDataFrame([(k, *map(float, b)) for k, b in enumerate(BOXES)], "qid long, min_x float, min_y float, max_x float, max_y float")
    want = sorted((k, i) for k, b in enumerate(BOXES) for i in oracle.descend(tree, root, tuple(map(G.f32, b)))[0])
    for most in (100, 0):
        assert sorted(map(tuple, query.batch_range_join(index, q, broadcast_queries=most).collect())) == want
    for r in query.batch_stats(index, q).collect():
        assert tuple(r[1:]) == oracle.descend(tree, root, tuple(map(G.f32, BOXES[r["qid"]])))[1]


def test_float32_literals(spark):
    index = build.build_index(frame(spark, {0: tuple(map(G.f32, (0.1, 0.1, 0.1, 0.1)))}))
    assert query.range_query(index, (0.1, 0.1, 0.1, 0.1)).count() == 1 and query.point_count(index, 0.1, 0.1).first()[0] == 1


@pytest.mark.parametrize("fills", [{"fill": 1.0}, {"fill": 0.7}, {"fill_leaf": 0.5, "fill_internal": 1.0}, {"fill": 0.25}, {"fill": 0.01}])
def test_audit_is_clean_for_every_fill(spark, fills):
    rects = generate.clustered_rects(spark, 3000, 7)
    index = build.build_index(rects, **fills)
    assert [tuple(r) for r in verify.verify(index, rects).filter("violations > 0").collect()] == []
    assert all(r["pages"] == r["expected"] for r in build.checked_shape(index).collect())


def broken(index, change):
    return build.RectIndex(change(index.entries), index.nodes, index.meta, index.pages, index.root_page)


def test_audit_finds_faults(spark):
    rects = generate.uniform_rects(spark, 500)
    index = build.build_index(rects, leaf_cap=10, internal_cap=10)
    bad = lambda ix: {r["check"] for r in verify.verify(ix, rects).filter("violations > 0").collect()}
    assert "no_object_missing" in bad(broken(index, lambda e: e.filter(~(F.col("is_leaf") & (F.col("child") == 7)))))
    assert "object_id_once" in bad(broken(index, lambda e: e.unionByName(e.filter(F.col("is_leaf") & (F.col("child") == 7)))))
    assert "parent_contains_children" in bad(broken(index, lambda e: e.withColumn("max_x", F.when(~F.col("is_leaf"), F.col("min_x")).otherwise(F.col("max_x")))))
    assert "leaf_equals_source" in bad(broken(index, lambda e: e.withColumn("min_x", F.when(F.col("is_leaf") & (F.col("child") == 7), F.col("min_x") - 1).otherwise(F.col("min_x")))))


@pytest.mark.parametrize("row", [(0, float("nan"), 0.0, 1.0, 1.0), (0, 0.0, 0.0, float("inf"), 1.0), (-1, 0.0, 0.0, 1.0, 1.0), (0, None, 0.0, 1.0, 1.0)])
def test_faulty_rows_raise(spark, row):
    df = spark.createDataFrame([row], "id long, min_x float, min_y float, max_x float, max_y float")
    with pytest.raises(Exception, match="finite"):
        build.build_index(df).entries.collect()


def test_empty_input(spark):
    with pytest.raises(ValueError, match="empty"):
        build.build_index(frame(spark, {0: (0.0, 0.0, 1.0, 1.0)}).limit(0))


def test_sweep_and_timing(spark):
    rects = generate.uniform_rects(spark, 2000)
    index = build.build_index(rects, leaf_cap=20, internal_cap=20)
    row = bench.sweep(index, 1.0, 5).first()
    assert row["avg_hits"] > 0 and 0 < row["pruned_pct"] < 100 and row["tests_per_page"] <= 20
    assert bench.timed(index, rects, 1.0, 3)["agrees"]
    with pytest.raises(ValueError):
        bench.sweep(index, 1.0, 0)


def test_range_predicates_reach_the_scan(spark, tmp_path):
    from tilewright.sources import store

    index = build.build_index(generate.uniform_rects(spark, 5000))
    store.save_index(index, str(tmp_path / "ix"))
    loaded = store.load_index(spark, str(tmp_path / "ix"))
    found = query.range_query(loaded, (100.0, 100.0, 200.0, 200.0))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(min_x,200.0)" in plan and "GreaterThanOrEqual(max_y,100.0)" in plan
    assert found.count() == query.range_query(index, (100.0, 100.0, 200.0, 200.0)).count()


def test_studies(spark):
    rects = lambda n: generate.uniform_rects(spark, n)
    rows = bench.crossover(rects, [200, 3000], selectivity_pct=1.0, runs=1)
    assert [r["rows"] for r in rows] == [200, 3000] and all(r["agrees"] and r["build_s"] > 0 for r in rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = bench.settings_sweep(spark, lambda: rects(500).groupBy("min_x").count().count(), {"spark.sql.shuffle.partitions": (1, 3), "spark.sql.files.maxPartitionBytes": ("1m",)})
    assert [r["value"] for r in found] == [1, 3, "1m"] and spark.conf.get("spark.sql.shuffle.partitions") == before
    study = bench.sort_study(rects(1000), (1, 4))
    assert {(r["n"], r["id_sum"], r["out_of_order"]) for r in study} == {(1000, 499500, 0)}
    report = bench.warm_up(lambda: rects(10).count(), 1)
    assert report["first_s"] > 0 and report["steady_s"] > 0


def test_audit_finds_broken_links(spark):
    index = build.build_index(generate.uniform_rects(spark, 500), leaf_cap=10, internal_cap=10)
    point = lambda at, to: broken(index, lambda e: e.withColumn("child", F.when((F.col("level") > 0) & (F.col("child") == at), to).otherwise(F.col("child"))))
    found = lambda ix: {r["check"]: r["violations"] for r in verify.verify(ix).filter("violations > 0").collect()}
    assert found(index) == {}
    dangling = found(point(7, 999))
    assert (dangling["page_exists"], dangling["page_reached"], dangling["page_id_in_range"]) == (1, 1, 1)
    twice = found(point(7, 8))
    assert (twice["page_reached"], twice["page_reached_once"]) == (1, 1) and "page_exists" not in twice
    to_root = found(point(7, index.root_page))
    assert to_root["page_reached_once"] == 1 and "leaves_at_one_depth" in to_root
    meta = index.meta.withColumn("num_nodes", F.col("num_nodes") - 1)
    wrong = found(build.RectIndex(index.entries, index.nodes, meta, index.pages, index.root_page))
    assert (wrong["node_count_as_stated"], wrong["page_id_in_range"]) == (1, 1)
    assert [tuple(r) for r in verify.samples(point(7, 999)).filter("check = 'page_reached'").collect()] == [("page_reached", 7)]
    assert [r["page"] for r in verify.faulty_pages(point(7, 999), "page_reached").collect()] == [7]
    assert [r["id"] for r in verify.faulty_objects(broken(index, lambda e: e.filter("level > 0 or child <> 3")), "no_object_missing").collect()] == [3]


def test_descent_broadcasts_internal_levels_and_joins_leaves(spark):
    index = build.build_index(generate.uniform_rects(spark, 3000), leaf_cap=10, internal_cap=10)
    queries = generate.uniform_rects(spark, 2000, seed=5).withColumnRenamed("id", "qid")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = query.batch_range_join(index, queries, broadcast_queries=100)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "CartesianProduct" not in plan
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in query.batch_range_join(index, queries).collect()}
        dealt = query.descend(index, query._queries(queries), broadcast_bytes=0).select("qid", F.col("child").alias("id"))
        assert dealt.exceptAll(found).count() == 0 and dealt.count() == found.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_nothing_stays_persisted_and_released_levels_go(spark):
    with build.build_index(generate.uniform_rects(spark, 300), leaf_cap=10, internal_cap=10) as index:
        paths = [level.written_at for level in index.kept]
        assert index.entries.count() > 300
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    assert all(not os.path.exists(p.removeprefix("file:")) for p in paths)
