"""The compact binary forms as Spark data sources: 24-byte rectangle records, and trees of 4096-byte pages.

Register with ``register(spark)``; then ``spark.read.format("rectbin").load(path)`` and ``df.write.format("rectbin").save(path)``, and
the same for ``recttree`` (its rows are entries; the header comes from ``read_header``). A path is a file or a folder whose
files, in the order of their names, make one. Readers split by offset, so one large file is read by many tasks; paths are
of a file system that all executors mount."""

from __future__ import annotations

import glob
import os
import struct
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import geometry as G
from ..functions import shape
from ..operators.build import RectIndex

# Little-endian layouts of a record, of a page's head, and of a tree's header.
RECORD = np.dtype([("min_x", "<f4"), ("min_y", "<f4"), ("max_x", "<f4"), ("max_y", "<f4"), ("child", "<u8")])
PAGE_HEAD = np.dtype([("count", "<u4"), ("is_leaf", "<u4")])
HEADER = "<IIIIIIffQQQffff"
HEADER_NAMES = ("magic", "page_bytes", "height", "max_entries_per_page", "leaf_cap", "internal_cap", "fill_leaf", "fill_internal", "num_rects", "num_nodes", "root_page", *(f"root_{s}" for s in G.SIDES))
#: Units (records or pages) that one input partition reads.
SPLIT_RECORDS, SPLIT_PAGES = 1 << 20, 1 << 14


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    found = sorted(f for f in glob.glob(f"{path}/*") if not os.path.basename(f).startswith(("_", "."))) if os.path.isdir(path) else [path]
    for f in found:
        if not os.path.exists(f):
            raise FileNotFoundError(f)
    return found


class Span(InputPartition):
    def __init__(self, file: str, start: int, count: int, ordinal: int):
        self.file, self.start, self.count, self.ordinal = file, start, count, ordinal


def spans(path: str, unit: int, step: int, skip: int = 0) -> list[Span]:
    """Runs of at most ``step`` units of ``unit`` bytes; trailing bytes are left out with a warning."""
    out, ordinal = [], 0
    for f in files_of(path):
        n, rest = divmod(os.path.getsize(f), unit)
        if rest:
            warnings.warn(f"{f}: {rest} trailing bytes ignored", stacklevel=2)
        out += [Span(f, s, min(step, n - s), ordinal + s) for s in range(skip, n, step)]
        ordinal, skip = ordinal + n, 0
    return out


class RectReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        found = spans(self.path, RECORD.itemsize, SPLIT_RECORDS)
        if not found:
            raise ValueError(f"{self.path}: empty input")
        return found

    def read(self, span):
        a = np.fromfile(span.file, RECORD, span.count, offset=span.start * RECORD.itemsize)
        if (a["child"] >> np.uint64(63)).any():
            raise ValueError(f"{span.file}: ids of 2^63 or more")
        yield pa.RecordBatch.from_arrays([pa.array(a["child"].astype(np.int64)), *(pa.array(np.ascontiguousarray(a[s])) for s in G.SIDES)], ["id", *G.SIDES])


class PartWritten(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


class PartWriter(DataSourceArrowWriter):
    """One file for each partition, named by its number. Files of an earlier save go when all parts of the new one are written; a failed job
    leaves them and none of its own."""

    def __init__(self, options, overwrite):
        self.folder = options["path"].removeprefix("file://")
        if os.path.exists(self.folder) and os.listdir(self.folder) and not overwrite:
            raise FileExistsError(self.folder)
        os.makedirs(self.folder, exist_ok=True)

    def payload(self, batch: pa.RecordBatch) -> bytes:
        raise NotImplementedError

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        part = f"{self.folder}/.{context.partitionId():010d}-{context.taskAttemptId()}.bin"
        size = 0
        with open(part, "wb") as out:
            for batch in iterator:
                size += out.write(self.payload(batch))
        if size:
            return PartWritten(part)
        os.remove(part)
        return PartWritten(None)

    def commit(self, messages):
        for f in files_of(self.folder):
            os.remove(f)
        for m in messages:
            if m is not None and m.file:
                os.replace(m.file, f"{self.folder}/part-{os.path.basename(m.file)[1:11]}.bin")

    def abort(self, messages):
        for m in messages:
            if m is not None and m.file and os.path.exists(m.file):
                os.remove(m.file)


class RectWriter(PartWriter):
    def payload(self, batch):
        a = np.zeros(batch.num_rows, RECORD)
        for s in G.SIDES:
            a[s] = batch.column(batch.schema.get_field_index(s)).to_numpy(zero_copy_only=False)
        a["child"] = batch.column(batch.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
        return a.tobytes()


class RectBin(DataSource):
    @classmethod
    def name(cls):
        return "rectbin"

    def schema(self):
        return "id long, min_x float, min_y float, max_x float, max_y float"

    def reader(self, schema):
        return RectReader(self.options)

    def writer(self, schema, overwrite):
        return RectWriter(self.options, overwrite)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        read_header(self.path)
        return spans(self.path, shape.PAGE_BYTES, SPLIT_PAGES, skip=1)

    def read(self, span):
        step = 1024
        for at in range(0, span.count, step):
            n = min(step, span.count - at)
            raw = np.fromfile(span.file, np.uint8, n * shape.PAGE_BYTES, offset=(span.start + at) * shape.PAGE_BYTES).reshape(n, shape.PAGE_BYTES)
            head = raw[:, : PAGE_HEAD.itemsize].copy().view(PAGE_HEAD)[:, 0]
            wrong = np.flatnonzero(head["count"] > shape.MAX_ENTRIES)
            if len(wrong):
                raise ValueError(f"{span.file}: page {span.ordinal + at + wrong[0]} states {head['count'][wrong[0]]} entries of at most {shape.MAX_ENTRIES}")
            cells = raw[:, PAGE_HEAD.itemsize : PAGE_HEAD.itemsize + shape.MAX_ENTRIES * RECORD.itemsize].copy().view(RECORD)
            slots = np.arange(shape.MAX_ENTRIES)[None, :]
            page, slot = np.nonzero(slots < head["count"][:, None])
            e = cells[page, slot]
            if (e["child"] >> np.uint64(63)).any():
                raise ValueError(f"{span.file}: ids of 2^63 or more")
            yield pa.RecordBatch.from_arrays(
                [pa.array(span.ordinal + at + page), pa.array(slot.astype(np.int32)), pa.array(head["is_leaf"][page] != 0), *(pa.array(np.ascontiguousarray(e[s])) for s in G.SIDES), pa.array(e["child"].astype(np.int64))],
                ["page", "slot", "is_leaf", *G.SIDES, "child"],
            )


class PageWriter(PartWriter):
    """Rows are page images in page order."""

    def payload(self, batch):
        return b"".join(batch.column(batch.schema.get_field_index("image")).to_pylist())


class RectTree(DataSource):
    @classmethod
    def name(cls):
        return "recttree"

    def schema(self):
        return "page long, slot int, is_leaf boolean, min_x float, min_y float, max_x float, max_y float, child long"

    def reader(self, schema):
        return TreeReader(self.options)

    def writer(self, schema, overwrite):
        return PageWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RectBin)
    spark.dataSource.register(RectTree)


def read_header(path: str) -> dict:
    """The header of a tree file; ValueError where the mark or the page size is another."""
    with open(files_of(path)[0], "rb") as f:
        raw = f.read(struct.calcsize(HEADER))
    if len(raw) < struct.calcsize(HEADER):
        raise ValueError(f"{path}: no tree header")
    head = dict(zip(HEADER_NAMES, struct.unpack(HEADER, raw), strict=True))
    if head["magic"] != shape.MAGIC or head["page_bytes"] != shape.PAGE_BYTES:
        raise ValueError(f"{path}: not a tree of {shape.PAGE_BYTES}-byte pages")
    return head


def pack_pages(entries: np.ndarray, counts: np.ndarray, is_leaf: np.ndarray) -> np.ndarray:
    """(pages, PAGE_BYTES): images of pages whose entries lie one after another."""
    out = np.zeros((len(counts), shape.PAGE_BYTES), np.uint8)
    head = np.zeros(len(counts), PAGE_HEAD)
    head["count"], head["is_leaf"] = counts, is_leaf
    out[:, : PAGE_HEAD.itemsize] = head.view(np.uint8).reshape(len(counts), -1)
    page = np.repeat(np.arange(len(counts)), counts)
    slot = np.arange(len(entries)) - np.repeat(np.cumsum(counts) - counts, counts)
    body = out[:, PAGE_HEAD.itemsize : PAGE_HEAD.itemsize + shape.MAX_ENTRIES * RECORD.itemsize].reshape(len(counts), shape.MAX_ENTRIES, RECORD.itemsize)
    cells = body.copy()
    cells[page, slot] = entries.view(np.uint8).reshape(len(entries), RECORD.itemsize)
    out[:, PAGE_HEAD.itemsize : PAGE_HEAD.itemsize + shape.MAX_ENTRIES * RECORD.itemsize] = cells.reshape(len(counts), -1)
    return out


def _images(batches):
    for whole in batches:
        for b in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
            column = b.column(2)
            cells, counts = column.flatten(), np.diff(column.offsets.to_numpy())
            a = np.zeros(len(cells), RECORD)
            for s in (*G.SIDES, "child"):
                a[s] = cells.field(cells.type.get_field_index(s)).to_numpy(zero_copy_only=False)
            images = pack_pages(a, counts, b.column(1).to_numpy(zero_copy_only=False))
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(shape.PAGE_BYTES), len(images), [None, pa.py_buffer(images.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), flat.cast(pa.binary())], ["page", "image"])


def write_rects(rects: DataFrame, path: str) -> None:
    """Records in id order, one file for each range of ids."""
    register(rects.sparkSession)
    G.checked(rects).repartitionByRange("id").sortWithinPartitions("id").write.format("rectbin").mode("overwrite").save(path)


def read_rects(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("rectbin").load(path)


def write_tree(index: RectIndex, path: str) -> None:
    """Page images in page order after the header page; the header goes last."""
    register(index.entries.sparkSession)
    cells = F.array_sort(F.collect_list(F.struct("slot", *G.SIDES, "child")))
    pages = index.entries.groupBy("page").agg(F.first("is_leaf").alias("is_leaf"), cells.alias("cells"))
    placed = pages.repartitionByRange("page").sortWithinPartitions("page").mapInArrow(_images, "page long, image binary")
    placed.write.format("recttree").mode("overwrite").save(path)
    m = index.meta.first().asDict() | {"magic": shape.MAGIC}
    head = struct.pack(HEADER, *(m[n] for n in HEADER_NAMES)).ljust(shape.PAGE_BYTES, b"\0")
    with open(f"{path.removeprefix('file://')}/head.bin", "wb") as f:
        f.write(head)


def read_tree(spark: SparkSession, path: str) -> RectIndex:
    """An index from a tree file: levels follow from the capacities, nodes from the entries."""
    register(spark)
    head = read_header(path)
    pages = shape.level_pages(head["num_rects"], head["leaf_cap"], head["internal_cap"])
    level, first = F.lit(None).cast("int"), 1
    bounds = []
    for number, count in enumerate(pages):
        bounds.append((number, first, first + count))
        first += count
    for number, lo, hi in reversed(bounds):
        level = F.when((F.col("page") >= lo) & (F.col("page") < hi), number).otherwise(level)
    entries = spark.read.format("recttree").load(path).withColumn("level", level).select(*(f.name for f in G.ENTRY_SCHEMA))
    nodes = entries.groupBy("page").agg(F.first("level").alias("level"), F.count(F.lit(1)).alias("node_count"), *G.union_of())
    meta = spark.createDataFrame([tuple(head[n] for n in HEADER_NAMES if n != "magic")], ", ".join(f"{n} {'float' if n.startswith(('fill', 'root_m')) else 'long'}" for n in HEADER_NAMES if n != "magic"))
    return RectIndex(entries, nodes, meta, pages, head["root_page"])
