"""Packing along a space-filling curve.

Each document becomes a hashed vector of its byte 4-grams, projected to few dimensions by a fixed random matrix and
scaled by the corpus' own mean and deviation. Documents are range-partitioned and sorted by the Hilbert key of that point
and packed one after another along the curve, cut wherever a sequence is full. What is left at a partition's end is cut
into powers of two, so no sequence needs padding.

Two passes read the texts: the first gives the small table of points (statistics, sampled splitters), the second deals
each text to its place on the curve. Texts move in one shuffle and are tokenised after it, once.
"""

from __future__ import annotations

import base64
import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialise, per_worker, small_batches

#: Buckets of the hashed vector, and dimensions and bits of each that the curve runs through.
BUCKETS, DIMS, BITS = 1024, 3, 10
#: Tokens of a sequence, and the id that ends a document.
MAX_TOKENS, END_ID = 1024, 0
#: Bytes of text that a partition takes where the session's shuffle partitions would take more.
PART_BYTES = 64 << 20
#: Sampled points from which the splitters are taken: for each partition, and in all.
SAMPLES, MOST_SAMPLES = 200, 1 << 20
VOCABULARY = "byte_bpe_50k"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of integer points (dims, n) below 2^bits (Skilling's transposed form)."""
    x = [p.astype(np.uint64) for p in points]
    zero, q = np.uint64(0), 1 << (bits - 1)
    while q > 1:
        flip = np.uint64(q - 1)
        for i in range(len(x)):
            on = (x[i] & np.uint64(q)) != 0
            swap = np.where(on, zero, (x[0] ^ x[i]) & flip)
            x[0] = np.where(on, x[0] ^ flip, x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for j in range(bits - 1, -1, -1):
        for v in x:
            key = key << np.uint64(1) | ((v ^ turn) >> np.uint64(j) & np.uint64(1))
    return key.astype(np.int64)


def _matrix() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMS))


def points_of(texts: list[bytes]) -> np.ndarray:
    """(texts, DIMS): projections of each text's hashed 4-gram vector, square-rooted and of unit length."""
    out = np.zeros((len(texts), DIMS))
    matrix = _matrix()
    for k, t in enumerate(texts):
        a = np.frombuffer(t + b"\0\0\0", np.uint8).astype(np.uint32)
        g = (a[:-3] | a[1:-2] << 8 | a[2:-1] << 16 | a[3:] << 24) * np.uint32(0x9E3779B1) >> np.uint32(22)
        v = np.sqrt(np.bincount(g, minlength=BUCKETS))
        out[k] = v @ matrix / max(1.0, np.sqrt(len(t)))
    return out


def keys_of(points: np.ndarray, mean: list[float], deviation: list[float]) -> np.ndarray:
    """Hilbert keys: each dimension through a logistic curve of its standard score, so that cells fill evenly."""
    z = (points - np.array(mean)) / np.array([d or 1.0 for d in deviation])
    cells = np.clip(np.floor((1 << BITS) / (1 + np.exp(-1.702 * np.clip(z, -30, 30)))), 0, (1 << BITS) - 1)
    return hilbert(cells.T, BITS)


def _points(batches):
    for b in batches:
        texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
        p = points_of(texts)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(p[:, d]) for d in range(DIMS))], ["id", "size", *(f"p{d}" for d in range(DIMS))])


def _dealt(mean, deviation, shared):
    def scan(batches):
        splitters = shared.value
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            keys = keys_of(points_of(texts), mean, deviation).tolist()
            ids = [-1 if i is None else i for i in b.column(0).to_pylist()]
            parts = [bisect.bisect_right(splitters, at) for at in zip(keys, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(keys, pa.int64()), pa.array(parts, pa.int32())], ["id", "text", "key", "part"])

    return scan


class Encoder:
    """Token ids as the vocabulary's ``tokenizers`` file gives them. The same vocabulary as ranks is several times faster and
    gives the same ids; texts that spell out the special token, or that it cannot split, go to the ``tokenizers`` file."""

    def __init__(self, folder: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(f"{folder}/{VOCABULARY}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(f"{folder}/{VOCABULARY}.json")

    def __call__(self, text: str) -> np.ndarray:
        if "<|endoftext|>" not in text:
            try:
                return self.fast.encode_to_numpy(text)
            except ValueError:  # the pattern's stack is full: hundreds of thousands of line ends in a row
                pass
            except BaseException as e:
                if type(e).__name__ != "PanicException":  # the native code's panic is not an Exception and has no importable type
                    raise
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def _packed(folder: str, max_tokens: int):
    def powers(rest: int) -> list[int]:
        return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]

    def recut(held: list, sizes: list[int]):
        """The pieces of one sequence, cut again into sequences of these sizes."""
        out, number, left = [[]], 0, sizes[0]
        for doc, start, ids, total in held:
            while len(ids):
                if not left:
                    number += 1
                    left = sizes[number]
                    out.append([])
                out[-1].append((doc, start, ids[:left], total))
                taken = min(left, len(ids))
                start, ids, left = start + taken, ids[taken:], left - taken
        return out

    def scan(batches):
        encode = per_worker(f"byte bpe {folder}", lambda: Encoder(folder))
        first, number, used, held, rows = TaskContext.get().partitionId() << 32, 0, 0, [], []

        def close(pieces):
            nonlocal number
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), ids.tobytes(), total, first + number, at))
                at += len(ids)
            number += 1

        def batch():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), END_ID).astype("<u4")
                start = 0
                while start < len(ids):
                    piece = ids[start : start + max_tokens - used]
                    held.append((doc, start, piece, len(ids)))
                    start, used = start + len(piece), used + len(piece)
                    if used == max_tokens:
                        close(held)
                        used, held = 0, []
                if len(rows) >= 4096:
                    yield batch()
        if used:
            for pieces in recut(held, powers(used)):
                close(pieces)
        if rows:
            yield batch()

    return scan


def pack(df: DataFrame, vocabulary_folder: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, partitions: int | None = None) -> DataFrame:
    """Pieces of documents in sequences: ``id, start, length, ids`` (little-endian uint32), ``doc_tokens, sequence_id, offset``.

    Null and empty texts are the end id alone. Every id of every row lies in one piece; equal rows are packed each for
    itself; a null id is packed like any other and sorts first; equal keys are ordered by id. An empty table gives an empty result.
    Other columns are not read. ``partitions`` defaults to the session's shuffle partitions, or to as many as ``PART_BYTES`` each
    make if that is more."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dims = [f"p{d}" for d in range(DIMS)]
    points = materialise(rows.mapInArrow(_points, "id long, size long, " + ", ".join(f"{d} double" for d in dims)), "points")
    n, size, *stats = points.agg(F.count(F.lit(1)), F.sum("size"), *(F.avg(d) for d in dims), *(F.stddev_pop(d) for d in dims)).first()
    mean, deviation = [v or 0.0 for v in stats[:DIMS]], [v or 0.0 for v in stats[DIMS:]]
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // PART_BYTES))
    # a bounded number of points; only the balance depends on them
    part = F.pmod(F.xxhash64("id", *dims), F.lit(1 << 30)) < int((1 << 30) * min(1.0, min(SAMPLES * partitions, MOST_SAMPLES) / max(n, 1)))
    sample = points.filter(part).toPandas()
    keys = keys_of(sample[dims].to_numpy(np.float64).reshape(-1, DIMS), mean, deviation)
    ids, sizes = sample["id"].fillna(-1).astype("int64").to_numpy(), sample["size"].to_numpy(np.int64)
    order = np.lexsort((sizes, ids, keys))
    filled = np.cumsum(sizes[order] + 64)
    cuts = order[np.searchsorted(filled, filled[-1] * np.arange(1, partitions) / partitions)] if len(order) else order
    shared = spark.sparkContext.broadcast(sorted(set(zip(keys[cuts].tolist(), ids[cuts].tolist(), strict=True))))  # less than a pair of numbers for each partition
    dealt = rows.mapInArrow(_dealt(mean, deviation, shared), "id long, text string, key long, part int")
    along = dealt.repartitionById(partitions, F.col("part")).sortWithinPartitions("key", "id")
    return along.select("id", "text").mapInArrow(_packed(vocabulary_folder, max_tokens), "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def default_vocabulary_folder() -> str:
    import os

    import public_tokenizers

    return os.path.dirname(public_tokenizers.path(f"{VOCABULARY}.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pack(documents(spark, sf_dir), default_vocabulary_folder())
    return p.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
