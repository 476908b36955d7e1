"""Selectivity sweeps: boxes from a selectivity, work averages over trials, and the brute-force cross-check."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import shape
from ..sources import store
from ..sources.scratch import discard, new_folder, remove, written
from .build import RectIndex, build_index
from .query import batch_stats, range_count

#: Trials of a sweep.
TRIALS = 20


def corners(trials: int, seed: int = 9876) -> list[tuple[float, float]]:
    """Where in the feasible area each trial's lower corner lies, as fractions."""
    rng = random.Random(seed)
    return [(rng.random(), rng.random()) for _ in range(trials)]


def selectivity_boxes(root: G.Box, selectivity_pct: float, at: Sequence[tuple[float, float]]) -> list[G.Box]:
    """Boxes of ``selectivity_pct`` of the root's area and of its proportions, each in float32."""
    side = math.sqrt(selectivity_pct / 100)
    w, h = (root[2] - root[0]) * side, (root[3] - root[1]) * side
    out = []
    for u, v in at:
        x, y = root[0] + u * (root[2] - root[0] - w), root[1] + v * (root[3] - root[1] - h)
        out.append(tuple(G.f32(c) for c in (x, y, x + w, y + h)))
    return out


def trial_queries(index: RectIndex, selectivity_pct: float, at: Sequence[tuple[float, float]]) -> DataFrame:
    """``qid`` and box of each trial, as one small table."""
    m = index.meta.select(*(F.col(f"root_{s}").cast("double") for s in G.SIDES)).first()
    boxes = selectivity_boxes(tuple(m), selectivity_pct, at)
    return index.entries.sparkSession.createDataFrame([(k, *b) for k, b in enumerate(boxes)], "qid long, min_x float, min_y float, max_x float, max_y float")


def sweep(index: RectIndex, selectivity_pct: float, trials: int = TRIALS, at: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """Averages over the trials: hits, pages, KB, percent pruned, tests for each page. Ratios over nothing are null."""
    if trials < 1:
        raise ValueError("at least one trial")
    stats = batch_stats(index, trial_queries(index, selectivity_pct, at or corners(trials)))
    return stats.agg(
        F.avg("results").alias("avg_hits"), F.avg("pages_read").alias("avg_pages"), (F.avg("pages_read") * shape.PAGE_BYTES / 1024).alias("avg_kb"),
        (F.sum("entries_pruned") * 100.0 / F.expr("nullif(sum(entries_tested), 0)")).alias("pruned_pct"), (F.sum("entries_tested") * 1.0 / F.sum("pages_read")).alias("tests_per_page"),
    )


def brute_force(rects: DataFrame, box: G.Box) -> DataFrame:
    """The same question to the bare table: a vectorised scan with the predicate pushed down."""
    return rects.filter(G.intersects(G.sides(), G.box_columns(box))).agg(F.count(F.lit(1)).alias("n"))


def equivalence(index: RectIndex, rects: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, index_hits, scan_hits`` for each query box."""
    q = queries.select("qid", *(F.col(s).alias(f"q_{s}") for s in G.SIDES))  # a small table of trials
    meets = G.intersects(G.sides(), [F.col(f"q_{s}") for s in G.SIDES])
    scan = rects.join(F.broadcast(q), meets).groupBy("qid").agg(F.count(F.lit(1)).alias("scan_hits"))
    own = batch_stats(index, queries).select("qid", F.col("results").alias("index_hits"))
    return own.join(scan, "qid", "left").withColumn("scan_hits", F.coalesce("scan_hits", F.lit(0).cast("long")))


def timed(index: RectIndex, rects: DataFrame | None, selectivity_pct: float, trials: int = TRIALS) -> dict:
    """Seconds of the batch of trials, and, with ``rects``, of one brute-force scan and whether both agree."""
    queries = trial_queries(index, selectivity_pct, corners(trials))
    began = time.perf_counter()
    stats = batch_stats(index, queries).collect()  # one row for each trial
    out = {"trials": trials, "batch_s": time.perf_counter() - began, "hits": sum(r["results"] for r in stats)}
    if rects is not None:
        first = queries.filter("qid = 0").first()
        began = time.perf_counter()
        n = brute_force(rects, tuple(first[s] for s in G.SIDES)).first()["n"]
        out |= {"scan_s": time.perf_counter() - began, "agrees": n == next(r["results"] for r in stats if r["qid"] == 0)}
    return out


def seconds(job: Callable[[], object]) -> float:
    began = time.perf_counter()
    job()
    return time.perf_counter() - began


def warm_up(job: Callable[[], object], runs: int = 3) -> dict:
    """Seconds of a job's first run, and of its fastest later one: what starting the session, loading classes and generating code cost is apart from
    the steady state."""
    first, *rest = (seconds(job) for _ in range(1 + runs))
    return {"first_s": first, "steady_s": min(rest), "warm_up_s": first - min(rest)}


def crossover(rects: Callable[[int], DataFrame], sizes: Sequence[int], selectivity_pct: float = 0.01, runs: int = 3) -> list[dict]:
    """For each size: seconds to pack and store ``rects(size)``, of one window query over the stored index and of a scan of the stored rows, each the
    fastest of some runs, and whether both agree. ``pays_after``: queries after which packing has paid, None if it never does."""
    out = []
    for n in sizes:
        table = written(rects(n), "crossover")
        path = new_folder(table.sparkSession, "crossover-index")

        def packed(table=table, path=path) -> None:
            with build_index(table) as index:
                store.save_index(index, path)

        build_s = seconds(packed)
        index = store.load_index(table.sparkSession, path)
        m = index.meta.select(*(F.col(f"root_{s}").cast("double") for s in G.SIDES)).first()
        box = selectivity_boxes(tuple(m), selectivity_pct, corners(1))[0]
        hits = [range_count(index, box).first()["n"], brute_force(table, box).first()["n"]]
        index_s = min(seconds(lambda: range_count(index, box).first()) for _ in range(runs))
        scan_s = min(seconds(lambda: brute_force(table, box).first()) for _ in range(runs))
        gain = scan_s - index_s
        out.append({"rows": n, "build_s": build_s, "index_s": index_s, "scan_s": scan_s, "agrees": hits[0] == hits[1], "pays_after": math.ceil(build_s / gain) if gain > 0 else None})
        remove(table.sparkSession, path)
        discard(table)
    return out


def settings_sweep(spark: SparkSession, job: Callable[[], object], settings: dict[str, Sequence[object]]) -> list[dict]:
    """Seconds of a job for each value of each session setting, one setting at a time (shuffle partitions, bytes of a scan's split, rows of a row group);
    the settings are as before afterwards."""
    out = []
    for name, values in settings.items():
        before = spark.conf.get(name, None)
        try:
            for value in values:
                spark.conf.set(name, str(value))
                out.append({"setting": name, "value": value, "seconds": seconds(job)})
        finally:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return out


def sort_study(rects: DataFrame, partitions: Sequence[int]) -> list[dict]:
    """The global order by the x key with its rows dealt over different numbers of ranges: seconds, rows, a checksum of ids, and rows whose key is less than
    that of the row before in their range. All but the seconds are the same for every number."""
    out = []
    for n in partitions:
        placed = rects.select("id", G.key_x().alias("key")).repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
        began = time.perf_counter()
        sorted_ = written(placed.select("id", "key", F.monotonically_increasing_id().alias("at")), "sort-study")
        took = time.perf_counter() - began
        before = F.lag("key").over(Window.partitionBy(F.shiftright("at", 33)).orderBy("at"))
        row = sorted_.select("id", (before > F.col("key")).alias("back")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"), F.count_if("back").alias("out_of_order")).first()
        out.append({"partitions": n, "seconds": took, **row.asDict()})
        discard(sorted_)
    return out
