"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes, Spark's external sort places equal texts next to each other,
and one streaming pass compares each text in full with its neighbour. The range key is (leading bytes, 64-bit hash,
id): the splitters that reach the driver are short whatever the texts are, and a group of copies of any size is cut by
id into as many partitions as its rows need. Runs that touch a partition's border are merged by full text afterwards;
there are at most a few of them for each partition.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ascii_lower, documents, materialise, small_batches

#: Characters of the normalised text that the splitters hold.
PREFIX = 24
#: Rows that a partition takes where the session's shuffle partitions would take more, and rows of a batch that tasks give out.
PART_ROWS, BLOCK = 1 << 18, 4096
_RUNS = "id long, sha string, run_id long, run_rows long, part int, run int, border string"


def normalised(text) -> F.Column:
    """A-Z lower-cased; null counts as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def _runs(keep_largest: bool):
    pick = max if keep_largest else min
    schema = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("run_id", pa.int64()), ("run_rows", pa.int64()), ("part", pa.int32()), ("run", pa.int32()), ("border", pa.string())])

    def scan(batches):
        part, out, rows = TaskContext.get().partitionId(), [], 0

        def flushed():
            nonlocal out, rows
            batch = pa.RecordBatch.from_arrays([pa.array([x for p in out for x in p[c]], f.type) for c, f in enumerate(schema)], schema=schema)
            out, rows = [], 0
            return batch

        def closed(text, ids, nulls, run, is_border):
            """The rows of a run that has ended, null ids first, in blocks; a border run carries its text once."""
            nonlocal rows
            sha, total = hashlib.sha256(text).hexdigest(), nulls + len(ids)
            best, border = pick(ids) if ids else None, text.decode() if is_border else None
            for at in range(0, total, BLOCK):
                own = [None] * (min(nulls, at + BLOCK) - at) + ids[max(0, at - nulls) : max(0, at + BLOCK - nulls)].tolist()
                n = len(own)
                out.append([own, [sha] * n, [best] * n, [total] * n, [part] * n, [run] * n, [None if at else border] + [None] * (n - 1)])
                rows += n
                if rows >= BLOCK:
                    yield flushed()

        # a run's ids are 8 bytes each until it ends; runs under the key of the last row may go on in the next partition and are held until the key changes
        first_key, held, text, key, ids, nulls, run = None, [], None, None, array("q"), 0, 0
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for i, t, k in zip(b.column(0).to_pylist(), texts, zip(b.column(2).to_pylist(), b.column(3).to_pylist()), strict=True):
                if k != key or t != text:
                    if text is not None:
                        held.append((text, ids, nulls, run))
                        if k != key:
                            for r in held:
                                yield from closed(*r, key == first_key)
                            held = []
                        run += 1
                    first_key = k if first_key is None else first_key
                    text, key, ids, nulls = t, k, array("q"), 0
                if i is None:
                    nulls += 1
                else:
                    ids.append(i)
        if text is not None:
            for r in [*held, (text, ids, nulls, run)]:
                yield from closed(*r, True)
        if out:
            yield flushed()

    return scan


def _dealt(rows: DataFrame, df: DataFrame, *by) -> DataFrame:
    """``rows`` of ``df`` by range. Counting reads no texts; the session's own number is left to the planner, which may join small partitions."""
    many = -(-df.count() // PART_ROWS)
    return rows.repartitionByRange(many, *by) if many > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartitionByRange(*by)


def _firsts(batches):
    """Of each run of equal texts the first row. Runs under the partition's first and last key may belong to runs of other partitions
    and carry their text; those of the key that was read last are held until it changes."""
    part, run, first_key, key, text, held = TaskContext.get().partitionId(), 0, None, None, None, []

    def rows(found, borders):
        nonlocal run
        n, run = len(borders), run + len(borders)
        return pa.RecordBatch.from_arrays([*found, pa.array([part] * n, pa.int32()), pa.array(range(run - n, run), pa.int32()), pa.array(borders, pa.string())], ["row", "id", "part", "run", "border"])

    def one_by_one(key):
        return [rows(found, [text.decode() if is_border else None]) for found, text, is_border in ((*h, key is None or key == first_key) for h in held)]

    for b in batches:
        if not b.num_rows:
            continue
        keys, starts, before = list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)), [], key
        first_key = keys[0] if first_key is None else first_key
        for i, (t, k) in enumerate(zip(b.column(4).cast(pa.binary()).to_pylist(), keys, strict=True)):
            if k != key or t != text:
                starts.append((i, t, k))
                key, text = k, t
        if key != before:
            yield from one_by_one(before)
            held = []
        done = [(i, t.decode() if k == first_key else None) for i, t, k in starts if k != key]
        if done:
            at = pa.array([i for i, _ in done], pa.int64())
            yield rows([b.column(0).take(at), b.column(1).take(at)], [t for _, t in done])
        held += [([b.column(0).slice(i, 1), b.column(1).slice(i, 1)], t) for i, t, k in starts if k == key]
    yield from one_by_one(None)


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None) -> DataFrame:
    """Rows of ``df``, whole, of each group of equal normalised texts one: that of the smallest id; of rows that repeat this id the least.

    Null text counts as empty. A null id stays only where its group has no other. An empty table gives an empty result. Other columns, whatever
    their names, pass through. Whole rows move once and the dropped ones end where their neighbour is seen."""
    small_batches(df.sparkSession)
    norm = (normalise or normalised)(F.col("text"))
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("row", "id", F.substring(norm, 1, PREFIX).alias("lead"), F.xxhash64(norm).alias("hash"))
    least = F.col("id").asc_nulls_last()
    dealt = _dealt(rows, df, "lead", "hash", least).withColumn("text", F.col("row")[text_col])
    placed = dealt.select("row", "id", "lead", "hash", norm.alias("norm")).sortWithinPartitions("lead", "hash", "norm", least, "row")
    kinds = T.StructType([rows.schema["row"], *T.StructType.fromDDL("id long, part int, run int, border string")])
    firsts = materialise(placed.mapInArrow(_firsts, kinds), "exact-firsts")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "part", "run")
    # a few runs for each partition, whatever the number of documents
    best = firsts.filter(F.col("border").isNotNull()).groupBy("border").agg(F.min(order).alias("b")).select("b.part", "b.run", F.lit(True).alias("best"))
    return firsts.join(F.broadcast(best), ["part", "run"], "left").filter(F.col("border").isNull() | F.col("best")).select("row.*")


def content_sort_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """Groups of equal normalised texts: ``id, keep_id, group_size, kept, text_sha256``, one row for each row of ``df``.

    ``keep``: which id of a group stays, ``smallest`` or ``largest``. Null text counts as empty and so equals it. A null id takes
    part in a group, but is never the one that stays unless the group has no other (then ``keep_id`` is null and all of its
    rows are kept). Rows that repeat the id that stays are all kept. An empty table gives an empty result. Columns other
    than the two named are not read, so their names cannot clash."""
    spark = df.sparkSession
    small_batches(spark)
    text = (normalise or normalised)(F.col(text_col))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("norm"))
    rows = rows.select("id", "norm", F.substring("norm", 1, PREFIX).alias("lead"), F.xxhash64("norm").alias("hash"))
    order = ["lead", "hash", "norm", "id"]
    placed = _dealt(rows, df, "lead", "hash", "id").sortWithinPartitions(*order)
    runs = materialise(placed.mapInArrow(_runs(keep == "largest"), _RUNS), "exact-runs")
    best = (F.max if keep == "largest" else F.min)("run_id")
    # a few runs for each partition, whatever the number of documents
    border = (
        runs.filter(F.col("border").isNotNull())
        .groupBy("border")
        .agg(best.alias("all_id"), F.sum("run_rows").alias("all_rows"), F.collect_list(F.struct("part", "run")).alias("at"))
        .select("all_id", "all_rows", F.explode("at").alias("at"))
        .select("at.part", "at.run", "all_id", "all_rows")
    )
    keep_id = F.coalesce("all_id", "run_id")
    return runs.join(F.broadcast(border), ["part", "run"], "left").select(
        "id",
        keep_id.alias("keep_id"),
        F.coalesce("all_rows", "run_rows").alias("group_size"),
        F.coalesce(F.col("id") == keep_id, keep_id.isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(documents(spark, sf_dir), keep="largest").withColumnRenamed("id", "doc_id")


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
