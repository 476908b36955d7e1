"""Suffix-array dedup of repeated 50-byte strings.

Sorting every suffix of a corpus moves far more than the corpus, so suffixes are thinned first, without losing a match:
of the k-mers in a 50-byte window, the one of least hash is the window's anchor, and equal windows have equal anchors at
equal offsets. Only suffixes around anchors are sorted.

1. Equal texts are represented by the smallest id; larger ids lose everything and take no further part.
2. Each text's anchors are dealt by k-mer hash and put in the order of (k-mer, context, id), by hashes. Of neighbours with one
   context the first owns it and the others are settled, and what is left of a k-mer with several ids is open.
3. Settled anchors are verified against the bytes: along a text they make runs that lie in one owner at one distance, runs are cut where the
   owner's text has a multiple of ``BLOCK``, and each cut's BLAKE2 digest is compared with that of the owner's own bytes. Equal cuts of
   one owner are one request, so an owner gets no more of them than its length allows, however many copies it has. Where any
   differs, two hashes have collided: all k-mers of that text's runs are open, with every row that they have.
4. Open anchors are dealt again with their context bytes. Within a k-mer, the suffixes from the anchor and the reversed
   prefixes before it are put in order by a mergesort that compares by the longest common extension, found by binary search
   on prefix polynomial hashes; neighbours' extensions are then verified byte by byte. The extensions cut each order into
   classes, and for each offset of the window the least id of a class decides. The order of a k-mer with more than ``HOT`` contexts is cut
   by sampled splitters and sorted in pieces, window by window, so no task holds a group of unbounded size.
5. Each text drops the union of its intervals.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BATCH_ROWS, discard, documents, materialise, release, small_batches

#: Bytes of a match, of a k-mer, and before an anchor within a window.
MATCH, KMER = 50, 20
BEFORE = MATCH - KMER
#: Contexts of one k-mer that one task takes, and bytes of an owner's text that one request covers at most.
HOT, BLOCK = 1 << 15, 256
#: Bytes of dealt anchors that one partition takes about, and of dealt anchors for a byte of text (one anchor in 16, 44 bytes each).
PARTITION_BYTES, DEALT = 64 << 20, 2.75
#: Texts from which frequent k-mers are known, the share of a mean partition that makes one frequent, and the ways that
#: its rows of one context are cut. They decide the dealing only, never results.
SAMPLE_TEXTS, FREQUENT, WAYS = 4000, 0.25, 16
#: Bits of the k-mer's and of the context's hash that count.
KMER_BITS, CONTEXT_BITS = 0xFFFFFFFFFFFF0000, 0xFFFFFFFFFFFFFFFF
# Odd multipliers of the polynomial hashes modulo 2^64.
_BASE, _CONTEXT_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_tables: list[tuple[SparkSession, str]] = []


@atexit.register
def _drop_all() -> None:
    for spark, name in _tables:
        try:
            if spark.sparkContext._jsc is not None:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the JVM is already gone
            return


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^n and their inverses."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n + 1, np.uint64(b))
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


class PrefixHashes:
    """Polynomial hashes of any substring from one running sum: sum of (byte + 1) * base^i, scaled back by base^-start."""

    def __init__(self, text: np.ndarray, base: int):
        up, self.down = _powers(base, len(text))
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


def _sliding(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of ``width`` elements, by doubling."""
    done = 1
    while done * 2 <= width:
        a = f(a[:-done], a[done:])
        done *= 2
    return f(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def anchors(h: np.ndarray) -> np.ndarray:
    """Starts of the k-mers that are least in some window; ``h`` has the hash of each k-mer."""
    width = BEFORE + 1
    least = _sliding(h, width, np.minimum)
    zeros = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([zeros, least, zeros]), width, np.maximum) == h)


def _anchor_rows(kmer_bits: int, context_bits: int):
    def scan(batches):
        yield from _anchored(batches, kmer_bits, context_bits)

    return scan


def _anchored(batches, kmer_bits: int, context_bits: int):
    for b in batches:
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        for k, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
            text = np.frombuffer(t, np.uint8)
            starts = np.arange(len(text) - KMER + 1)
            h = PrefixHashes(text, _BASE)(starts, starts + KMER)
            at = anchors(h)
            lo, hi = np.maximum(at - BEFORE, 0), np.minimum(at + MATCH, len(text))
            # a context cut by the text's start or end equals only one that is cut likewise
            context = PrefixHashes(text, _CONTEXT_BASE)(lo, hi) ^ ((at - lo) << 8 | (hi - at)).astype(np.uint64)
            for c, v in zip(cols, (h[at] & np.uint64(kmer_bits), context & np.uint64(context_bits), np.full(len(at), ids[k]), np.full(len(at), keys[k]), at), strict=True):
                c.append(v)
        if cols[0]:
            kmer, context, *rest = (np.concatenate(c) for c in cols)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (kmer.view(np.int64), context.view(np.int64), *rest[:2], rest[2].astype(np.int32))], ["kmer", "context", "id", "key", "at"])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any of the columns."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _settle(batches):
    """Rows sorted by (kmer, salt, context, id): settled ones with their owner's anchor, and open ones with none. Between batches it carries
    the first row of the current context and the open rows of the current k-mer for as long as they are of one document. A frequent k-mer (salt
    over 0) lies in many tasks and has several documents for sure."""
    names = ["kmer", "id", "key", "at", "oid", "okey", "oat"]
    marker, held, several = None, None, None

    def rows(part, owner=None):
        kmer, _, *rest = part
        owner = [pa.array(c) for c in owner] if owner else [pa.nulls(len(kmer), t) for t in (pa.int64(), pa.int64(), pa.int32())]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in (kmer, *rest)), *owner], names)

    def split(part, last: bool):
        """Open rows that go on, those that wait."""
        nonlocal several
        new = _starts(part[0], part[1])
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        many = (np.minimum.reduceat(part[2], first) != np.maximum.reduceat(part[2], first)) | (part[1][first] > 0)
        if several is not None:
            many[part[0][first] == several] = True
        wait = np.zeros(len(first), bool)
        if not last:
            wait[-1] = not many[-1]
            several = part[0][-1] if many[-1] else None
        return [c[many[group]] for c in part], [c[wait[group]] for c in part]

    for b in batches:
        kmer, salt, context, ids, keys, at = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(kmer):
            continue
        new = _starts(kmer, salt, context)
        if marker is not None:
            new[0] = (kmer[0], salt[0], context[0]) != marker[:3]
        run, first = np.cumsum(new) - 1, np.flatnonzero(new)
        # of each row: the anchor that owns its context; of rows before the first new context, the marker's
        owner = [np.where(run >= 0, c[first][np.maximum(run, 0)] if len(first) else c[0], c.dtype.type(marker[3 + k] if marker else 0)) for k, c in enumerate((ids, keys, at))]
        marker = (kmer[-1], salt[-1], context[-1], *(c[-1] for c in owner))
        part = [kmer, salt, ids, keys, at]
        open_ = ids == owner[0]
        if not open_.all():
            yield rows([c[~open_] for c in part], [c[~open_] for c in owner])
        part = [c[open_] for c in part]
        if several is not None and len(part[0]) == 0 and kmer[-1] != several:
            several = None
        if held is not None:
            part = [np.concatenate(x) for x in zip(held, part, strict=True)]
        if len(part[0]):
            go, held = split(part, False)
            if len(go[0]):
                yield rows(go)
            held = held if len(held[0]) else None


def settled_runs(at: list[int], owners: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int, int, int]]:
    """Settled anchors of a text of n bytes, with the anchors that own them, as runs cut at the owner's blocks: (start, length, owner's id, key, start).
    What anchors of one owner and one distance cover together is one run."""
    out = []
    by = sorted((*o[:2], o[2] - a, a) for a, o in zip(at, owners, strict=True))
    k = 0
    while k < len(by):
        oid, okey, far, a = by[k]
        start, stop = max(0, a - BEFORE), min(n, a + MATCH)
        k += 1
        while k < len(by) and by[k][:3] == (oid, okey, far) and by[k][3] - BEFORE <= stop:
            stop = min(n, by[k][3] + MATCH)
            k += 1
        while start < stop:
            cut = min(stop, ((start + far) // BLOCK + 1) * BLOCK - far)
            out.append((start, cut - start, oid, okey, start + far))
            start = cut
    return out


def _digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


_CONTEXTS = "kmer long, id long, key long, at int, before int, bytes binary, length int, oid long, okey long, ostart int"


def _contexts(batches):
    """Of each text: the bytes around its open anchors, and (kmer null) its settled runs, whose bytes are a digest."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    names = [c.split()[0] for c in _CONTEXTS.split(", ")]
    for b in batches:
        out: list[list] = [[] for _ in kinds]
        for i, key, t, *lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), *(c.to_pylist() for c in b.columns[3:]), strict=True):
            settled, owners = [], []
            for a, kmer, *owner in zip(*lists, strict=True):
                if owner[0] is None:
                    lo = max(0, a - BEFORE)
                    for c, v in zip(out, (kmer, i, key, a, a - lo, t[lo : a + MATCH], None, None, None, None), strict=True):
                        c.append(v)
                else:
                    settled.append(a)
                    owners.append(tuple(owner))
            for start, length, oid, okey, ostart in settled_runs(settled, owners, len(t)):
                for c, v in zip(out, (None, i, key, start, None, _digest(t[start : start + length]), length, oid, okey, ostart), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _differing(batches):
    """Requests whose digest is not that of the owner's own bytes."""
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for i, key, t, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
            for r in asked:
                start, length = r["ostart"], r["length"]
                if start < 0 or start + length > len(t) or _digest(t[start : start + length]) != r["bytes"]:
                    for c, v in zip(out, (i, key, start, length, r["bytes"]), strict=True):
                        c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["oid", "okey", "ostart", "length", "bytes"])


class SuffixOrder:
    """Rows of symbols in lexicographic order within their groups, and how far each agrees with the row before it."""

    def __init__(self, symbols: np.ndarray, group: np.ndarray):
        """``group``: ascending."""
        self.symbols, self.width = symbols, symbols.shape[1]
        up, _ = _powers(_BASE, self.width)
        self.hashes = np.zeros((len(symbols), self.width + 1), np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[: self.width], axis=1, out=self.hashes[:, 1:])
        new = _starts(group)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(group)))
        self.order = np.arange(len(group))
        self._merge(np.repeat(first, size), np.repeat(size, size))
        self.common = np.full(len(group), -1)
        a, b = self.order[:-1], self.order[1:]
        same = symbols[a] == symbols[b]
        true = np.where(same.all(axis=1), self.width, same.argmin(axis=1))
        fine = group[a] != group[b]
        ascending = symbols[a, np.minimum(true, self.width - 1)] <= symbols[b, np.minimum(true, self.width - 1)]
        if not (fine | ascending).all():  # two hashes have collided: by bytes instead
            self.order = np.lexsort((*symbols.T[::-1], group))
            a, b = self.order[:-1], self.order[1:]
            same = symbols[a] == symbols[b]
            true = np.where(same.all(axis=1), self.width, same.argmin(axis=1))
        self.common[1:] = np.where(fine, -1, true)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of rows a and b by binary search on their prefix hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.width)
        for _ in range(self.width.bit_length()):
            mid = (lo + hi + 1) // 2
            same = self.hashes[a, mid] == self.hashes[b, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.extension(a, b)
        whole = n == self.width
        n = np.minimum(n, self.width - 1)
        return np.where(whole, or_equal, self.symbols[a, n] < self.symbols[b, n])

    def _merge(self, first: np.ndarray, size: np.ndarray) -> None:
        """Bottom-up mergesort of all groups at once: each row's new place is its own plus its rank in the neighbouring run."""
        width = 1
        while (active := np.flatnonzero(size > width)).size:
            own, start, n = self.order[active], first[active], size[active]
            run, offset = np.divmod(active - start, width)
            other = start + (run ^ 1) * width
            length = np.clip(start + n - other, 0, width)
            lo, hi, right = np.zeros(len(own), np.int64), length.copy(), run % 2 == 1
            while (todo := np.flatnonzero(lo < hi)).size:
                mid = (lo[todo] + hi[todo]) // 2
                before = self.less(self.order[other[todo] + mid], own[todo], right[todo])
                lo[todo], hi[todo] = np.where(before, mid + 1, lo[todo]), np.where(before, hi[todo], mid)
            self.order[start + (run & ~1) * width + offset + lo] = own
            width *= 2

    def classes(self, least: int) -> np.ndarray:
        """Of each row: the class of rows in its group that agree with it on ``least`` symbols."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < least)
        return out


def repeats(group: np.ndarray, ids: np.ndarray, before: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How far before and after its anchor each row is covered by windows that a smaller id of its group has; 0, 0 for none."""
    n = len(ids)
    symbols = np.empty((n, BEFORE + MATCH), np.int64)
    symbols[:] = 256 + np.arange(n)[:, None]  # what lies outside a text equals nothing
    after = np.array([len(c) for c in contexts]) - before
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    lengths = before + after
    row = np.repeat(np.arange(n), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(BEFORE - before, lengths)
    symbols[row, column] = flat
    right, left = SuffixOrder(symbols[:, BEFORE:], group), SuffixOrder(symbols[:, :BEFORE][:, ::-1], group)
    most, least = np.full(n, -1), np.full(n, MATCH + 1)
    for offset in range(BEFORE + 1):
        fits = np.flatnonzero((before >= offset) & (after >= MATCH - offset))
        if not len(fits):
            continue
        pair = right.classes(MATCH - offset)[fits] * (n + 1) + left.classes(offset)[fits]
        order = np.argsort(pair, kind="stable")
        cuts = np.flatnonzero(_starts(pair[order]))
        smallest = np.empty(len(fits), np.int64)
        smallest[order] = np.repeat(np.minimum.reduceat(ids[fits][order], cuts), np.diff(np.append(cuts, len(fits))))
        found = fits[ids[fits] > smallest]
        most[found], least[found] = offset, np.minimum(least[found], offset)
    some = most >= 0
    return np.where(some, most, 0), np.where(some, MATCH - least, 0)


def _repeated(batches):
    """Rows of whole k-mers together, sorted by k-mer: intervals of repeated bytes."""
    carry: pa.Table | None = None

    def found(t: pa.Table):
        kmer, ids, keys, at, before = (t.column(c).to_numpy() for c in range(5))
        lo, hi = repeats(np.cumsum(_starts(kmer)), ids, before.astype(np.int64), t.column(5).to_pylist())
        some = hi > 0
        return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (ids, keys, (at - lo).astype(np.int32), (at + hi).astype(np.int32))], ["id", "key", "start", "stop"])

    for b in batches:
        t = pa.Table.from_batches([b])
        carry = t if carry is None else pa.concat_tables([carry, t])
        if carry.num_rows < 4096:
            continue
        kmer = carry.column(0).to_numpy()
        whole = int(np.searchsorted(kmer, kmer[-1]))
        if whole:
            yield found(carry.slice(0, whole))
            carry = carry.slice(whole)
    if carry is not None and carry.num_rows:
        yield found(carry)


def _neighbours(batches):
    """Windows sorted by (bytes, id): those that equal a neighbour before them of a smaller id, the ``owner`` of their run. Runs that touch
    the partition's border may go on beyond it: all of their rows come, with their window."""
    first = run = owner = None
    done, held = [], []

    def batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "key", "start", "owner", "border"])

    def let_out(border):
        done.extend([(*r, run) for r in held] if border else [(*r, None) for r in held if r[0] > r[3]])
        held.clear()

    for b in batches:
        for i, key, start, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if w != run:
                let_out(run == first)
                first = w if first is None else first
                run, owner = w, i
            held.append((i, key, start, owner))
            if len(held) >= 4096:  # a run of any length passes in parts
                let_out(run == first)
            if len(done) >= 4096:
                yield batch(done)
                done = []
    let_out(True)
    if done:
        yield batch(done)


def _hot_repeats(rows: DataFrame) -> DataFrame:
    """The same for k-mers of many contexts: their windows are dealt by sampled splitters of (bytes, id), sorted, and compared with their neighbours in full,
    so that a run of equal windows is cut into as many partitions as it needs. The least id of a run over a border comes from a combining
    aggregate over such runs alone."""
    offset = F.explode(F.sequence(F.greatest(F.lit(0), MATCH - F.octet_length("bytes") + F.col("before")), F.least(F.lit(BEFORE), F.col("before")))).alias("offset")
    w = rows.select("id", "key", "at", "before", "bytes", offset)
    window = F.substring("bytes", F.col("before") - F.col("offset") + 1, F.lit(MATCH))
    w = w.select("id", "key", (F.col("at") - F.col("offset")).alias("start"), window.alias("window"))
    placed = w.repartitionByRange("window", "id").sortWithinPartitions("window", "id")
    found = materialise(placed.mapInArrow(_neighbours, "id long, key long, start int, owner long, border binary"), "hot-windows")
    border = found.filter(F.col("border").isNotNull())
    least = border.groupBy("border").agg(F.min("owner").alias("least"))
    # the window beside the document: no key of the join holds a whole run
    owned = border.join(least.select("border", F.col("least").alias("id")), ["border", "id"], "left_anti")
    spans = found.filter(F.col("border").isNull()).select("id", "key", "start").unionByName(owned.select("id", "key", "start"))
    return spans.select("id", "key", "start", (F.col("start") + MATCH).alias("stop"))


def _cut(batches):
    for b in batches:
        out: list[list] = [[], [], [], []]
        for i, t, spans in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            kept, removed, n, at = [], 0, 0, 0
            for start, stop in merged(spans or []):
                kept.append(t[at:start])
                removed, n, at = removed + stop - start, n + 1, stop
            kept.append(t[at:])
            for c, v in zip(out, (i, removed, n, b"".join(kept)), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["id", "n_removed", "n_spans", "kept"])


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _bucketed(rows: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """``rows`` as a table in the warehouse, dealt by ``by``: later joins on these columns do not move it."""
    spark, name = rows.sparkSession, f"suffix_texts_{uuid.uuid4().hex}"
    _tables.append((spark, name))
    rows.repartition(buckets, *by).write.format("parquet").option("compression", "zstd").bucketBy(buckets, *by).saveAsTable(name)
    return spark.table(name)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay), one row for each row of ``df``.

    A byte goes if a string of 50 bytes that covers it also starts in a text of smaller id; all is judged on the input.
    Null and empty texts are no bytes. Rows with a null id keep everything and take nothing from others. Rows that share an
    id take nothing from each other, equal or not. An empty table gives an empty result. Other columns are not read."""
    spark = df.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    keys = materialise(rows.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")), "texts")
    judged = (F.col("id").isNotNull()) & (F.col("n_bytes") >= MATCH)
    owners = materialise(keys.filter(judged).groupBy("sha").agg(F.min(F.struct("id", "key")).alias("o")).select("o.id", "o.key"), "owners")
    size = keys.agg(F.sum("n_bytes")).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size * DEALT / PARTITION_BYTES) + 1)
    texts = _bucketed(rows.filter(F.col("id").isNotNull() & (F.octet_length("text") >= MATCH)).join(owners, ["id", "key"], "left_semi"), ["id", "key"], partitions)
    release(spark)

    kind, anchored = "kmer long, context long, id long, key long, at int", _anchor_rows(KMER_BITS, CONTEXT_BITS)
    dealt = texts.select("id", "key", "text").mapInArrow(anchored, kind)
    share = min(1.0, SAMPLE_TEXTS / max(1, owners.count()))
    sampled = texts.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = materialise(sampled.select("id", "key", "text").mapInArrow(anchored, kind).groupBy("kmer").agg(F.count(F.lit(1)).alias("n")), "sampled-kmers")
    least = (counts.agg(F.sum("n")).first()[0] or 0) * FREQUENT / partitions
    # by their shares at most partitions / FREQUENT of them
    frequent = materialise(counts.filter((F.col("n") > least) & (F.col("n") > 1)).select("kmer", F.lit(True).alias("frequent")), "frequent-kmers")
    salt = F.when(F.col("frequent"), 1 + F.pmod(F.xxhash64("context", F.pmod(F.xxhash64("id"), F.lit(WAYS))), F.lit(1 << 20))).otherwise(F.lit(0)).cast("int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(32 * BATCH_ROWS))  # rows of a few numbers
    salted = dealt.join(F.broadcast(frequent), "kmer", "left").select("kmer", salt.alias("salt"), "context", "id", "key", "at")
    sorted_ = salted.repartition(partitions, "kmer", "salt").sortWithinPartitions("kmer", "salt", "context", "id")
    settled = materialise(sorted_.mapInArrow(_settle, "kmer long, id long, key long, at int, oid long, okey long, oat int"), "anchors")
    small_batches(spark)
    release(spark)

    fields = ("at", "kmer", "oid", "okey", "oat")

    def around(anchors: DataFrame) -> DataFrame:
        at = anchors.groupBy("id", "key").agg(F.collect_list(F.struct(*fields)).alias("a"))
        return texts.join(at, ["id", "key"]).select("id", "key", "text", *(f"a.{f}" for f in fields)).mapInArrow(_contexts, _CONTEXTS)

    both = materialise(around(settled), "contexts")
    contexts, runs = both.filter(F.col("kmer").isNotNull()), both.filter(F.col("kmer").isNull())
    asked = ("ostart", "length", "bytes")
    requests = runs.select("oid", "okey", *asked).distinct().groupBy("oid", "okey").agg(F.collect_list(F.struct(*asked)).alias("asked"))
    requests = requests.select(F.col("oid").alias("id"), F.col("okey").alias("key"), "asked")
    differing = texts.join(requests, ["id", "key"]).select("id", "key", "text", "asked").mapInArrow(_differing, "oid long, okey long, ostart int, length int, bytes binary")
    differing = materialise(differing, "differing-runs")
    if differing.head(1):  # two hashes have collided: every row of the k-mers of such a text's runs is open
        wrong = materialise(runs.join(differing, ["oid", "okey", *asked], "left_semi").select("id", "key").distinct(), "collided-texts")
        kmers = materialise(settled.filter(F.col("oid").isNotNull()).join(wrong, ["id", "key"], "left_semi").select("kmer").distinct(), "collided-kmers")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("oid", "long"), ("okey", "long"), ("oat", "int"))]
        again = around(dealt.join(kmers, "kmer", "left_semi").select("kmer", "id", "key", "at", *none))
        contexts = contexts.join(kmers, "kmer", "left_anti").unionByName(materialise(again, "collided-contexts"))
        runs = runs.join(wrong, ["id", "key"], "left_anti")
    hot = materialise(contexts.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("kmer"), "hot-kmers")
    few = F.broadcast(hot)  # one row for each HOT contexts at most
    cool = contexts.join(few, "kmer", "left_anti").select("kmer", "id", "key", "at", "before", "bytes").repartition(partitions, "kmer").sortWithinPartitions("kmer")
    spans = cool.mapInArrow(_repeated, "id long, key long, start int, stop int")
    if hot.head(1):
        spans = spans.unionByName(_hot_repeats(contexts.join(few, "kmer", "left_semi")))
    whole = runs.select("id", "key", F.col("at").alias("start"), (F.col("at") + F.col("length")).alias("stop"))
    spans = materialise(spans.unionByName(whole).groupBy("id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    discard(both)
    discard(settled)

    clip = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.least(s["stop"], F.octet_length("text")).alias("stop")))
    cut = texts.join(spans, ["id", "key"], "left").select("id", "text", clip.alias("spans")).mapInArrow(_cut, "id long, n_removed long, n_spans long, kept binary")
    cut = cut.select("id", (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans", "kept")
    copies = keys.filter(judged).join(owners, ["id", "key"], "left_anti").select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    whole_rows = rows.filter(F.col("id").isNull() | (F.octet_length("text") < MATCH))
    untouched = whole_rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(copies).unionByName(untouched)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup(documents(spark, sf_dir))
    return d.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes]) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all windows, for small inputs: id to n_bytes, n_removed, n_spans, kept_sha256."""
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        t = texts[i]
        own = [t[s : s + MATCH] for s in range(len(t) - MATCH + 1)]
        spans = merged([{"start": s, "stop": s + MATCH} for s, w in enumerate(own) if w in seen])
        seen.update(own)
        kept, at = [], 0
        for start, stop in spans:
            kept.append(t[at:start])
            at = stop
        kept.append(t[at:])
        out[i] = (len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest())
    return out


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS s FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
r AS (SELECT doc_id, s FROM w JOIN f USING (g) WHERE first < doc_id),
i AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS new FROM r),
k AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM i),
sp AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM k GROUP BY doc_id, k),
seg AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM sp
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), n FROM d LEFT JOIN sp ON sp.doc_id = d.doc_id GROUP BY d.doc_id, n
),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS k FROM seg JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM sp GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""
