"""SimHash near-dedup by the generalised pigeonhole.

Fingerprints within ``RADIUS`` bits are linked. The 64 bits are grouped into partitions of correlated bits (correlations
over all fingerprints), and each partition gets a threshold of its own, so that the thresholds sum to radius - parts + 1:
two fingerprints within the radius then agree within the threshold on some partition. A dynamic programme picks the
number of partitions and the thresholds with the least estimated cost; the estimates decide speed only, never results.
Each distinct fingerprint is dealt to the keys of its partitions. Members of a key are verified in full and only the edges
of a spanning forest leave the task; within a key of more than ``DIRECT`` members the pigeonhole is applied again to the bits that the key leaves open, so
their comparisons do not grow with the square. A key over ``GROUP`` members is cut into pairs of blocks. Components come from
alternating large and small stars over those edges; the join that hooks a node to its neighbours is salted, so a hub is many tasks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, documents, materialise, small_batches

#: Words of a shingle, seed of its XXH64 and bits that linked fingerprints may differ by.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints from which candidate counts are estimated, and what a dealt row costs against a verified pair.
SAMPLE, ROW_COST = 3000, 30
#: Members of a key that one task takes at once, and members that are compared one with another.
GROUP, DIRECT = 1 << 19, 1 << 11
#: Ways that the neighbours of a hub are cut, and neighbours that make a node one.
HUB_WAYS, HUB = 64, 1 << 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, or of all words where there are fewer."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z alone, and exactly the ASCII white space
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts, digest = [0, *ends], xxhash.xxh64_intdigest
    last = shingle - 1
    if len(words) <= last:
        return np.array([digest(joined, SEED)], np.uint64)
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[last:], strict=False)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes) -> int:
    """Majority of each bit over the XXH64 of all word shingles; 0 without words."""
    return majority(shingle_hashes(text)) if text.strip() else 0


def _fingerprints(batches):
    for b in batches:
        made: dict[bytes, int] = {}
        out = []
        for t in b.column(1).cast(pa.binary()).to_pylist():
            t = t or b""
            if t not in made:
                made[t] = fingerprint(t)
            out.append(made[t])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["id", "fp"])


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches):
    """How often each two bits are set together: 64 rows for each task."""
    total = np.zeros((64, 64), np.int64)
    for b in batches:
        x = _bits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
        total += np.rint(x.T @ x).astype(np.int64)
    i, j = np.divmod(np.arange(4096), 64)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "n"])


def correlated_parts(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near-equal width, each grown by the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    corr = np.abs(np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0))
    left, found = list(range(64)), []
    for k in range(parts):
        group = [left.pop(0)]
        while len(group) < (64 + k) // parts:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        found.append(sorted(group))
    return found


def values_of(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= (fps >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def _rows_of(width: int, threshold: int) -> int:
    """Keys that one fingerprint is dealt to."""
    return 0 if threshold < 0 else 1 + (width if threshold > 0 else 0) + (width * (width - 1) // 2 if threshold > 1 else 0)


def plan(together: np.ndarray, n: int, sample: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of least estimated cost: (bits, threshold), a threshold of -1 leaving its partition out."""
    best = None
    ups = (n / max(len(sample), 1)) ** 2
    for parts in range(2, radius + 2):
        groups = correlated_parts(together, n, parts)
        cost = []
        for bits in groups:
            v = values_of(sample, bits)
            near = np.zeros(3)
            for k in range(len(v)):
                near += np.bincount(np.minimum(np.bitwise_count(v[k + 1 :] ^ v[k]), 3), minlength=4)[:3]
            # where the sample holds no pair, what independent bits would give
            floor = n * n / 2 / 2.0 ** len(bits)
            cost.append({t: 0.0 if t < 0 else max(near[: t + 1].sum() * ups, floor) * _rows_of(len(bits), t) + ROW_COST * n * _rows_of(len(bits), t) for t in (-1, 0, 1, 2)})
        # least cost of the first partitions for each sum of thresholds
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            after: dict[int, tuple[float, list[int]]] = {}
            for total, (spent, chosen) in table.items():
                for t, more in c.items():
                    if total + t not in after or spent + more < after[total + t][0]:
                        after[total + t] = (spent + more, [*chosen, t])
            table = after
        if radius - parts + 1 not in table:  # a threshold is 2 at most
            continue
        spent, chosen = table[radius - parts + 1]
        if best is None or spent < best[0]:
            best = (spent, list(zip(groups, chosen, strict=True)))
    return best[1]


def _dealt(scheme):
    def scan(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            for part, (bits, threshold) in enumerate(scheme):
                if threshold < 0:
                    continue
                v = values_of(fps.view(np.uint64), bits).astype(np.int64)
                for flips in range(threshold + 1):
                    for flipped in itertools.combinations(range(len(bits)), flips):
                        key = (v ^ sum(1 << f for f in flipped)) | part << 40
                        yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), b.column(1)], ["key", "fp", "owner"])

    return scan


def forest(fps: np.ndarray, owners: np.ndarray, radius: int = RADIUS, direct: int | None = None) -> list[tuple[int, np.ndarray]]:
    """(root, others) for each connected set of more than one: linked members are taken out as soon as one is reached, so a
    dense group costs far fewer comparisons than it has pairs. More than ``direct`` members are dealt again, and again, by the bits in which they differ."""
    direct = DIRECT if direct is None else direct
    if len(fps) > direct:
        spread = np.bitwise_or.reduce(fps ^ fps[0])
        open_ = [b for b in range(64) if int(spread) >> b & 1]
        if len(open_) > 2 * (radius + 1):
            return _dealt_again(fps, owners, open_, radius, direct)
    out = []
    left, at = fps, owners
    while len(left) > 1:
        found, queue = [at[:1]], [left[:1]]
        left, at = left[1:], at[1:]
        while queue and len(left):
            for f in queue.pop():
                near = np.bitwise_count(left ^ f) <= radius
                if near.any():
                    queue.append(left[near])
                    found.append(at[near])
                    left, at = left[~near], at[~near]
        if len(found) > 1:
            members = np.concatenate(found)
            root = members.min()
            out.append((int(root), members[members != root]))
    return out


def _dealt_again(fps: np.ndarray, owners: np.ndarray, bits: list[int], radius: int, direct: int) -> list[tuple[int, np.ndarray]]:
    """``forest`` of many members: within the radius they agree on one of radius + 1 groups of the open bits, so members with equal values of a group
    are searched among themselves, a group at a time, and the found sets are joined."""
    root = np.arange(len(fps))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    parts = radius + 1
    for p in range(parts):
        own = bits[p::parts]  # neighbouring bits go to different groups
        v = values_of(fps, own)
        order = np.argsort(v, kind="stable")
        cuts = np.flatnonzero(np.diff(v[order])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(v)], strict=True):
            some = order[lo:hi]
            if hi - lo > 1:
                for first, others in forest(fps[some], some, radius, direct):
                    for k in others.tolist():
                        a, b = top(first), top(k)
                        root[max(a, b)] = min(a, b)
    while (root != root[root]).any():
        root = root[root]
    order = np.argsort(root, kind="stable")
    cuts = np.flatnonzero(np.diff(root[order])) + 1
    out = []
    for lo, hi in zip([0, *cuts], [*cuts, len(root)], strict=True):
        if hi - lo > 1:
            members = owners[order[lo:hi]]
            least = members.min()
            out.append((int(least), members[members != least]))
    return out


def _linked(radius: int):
    def scan(batches):
        keys, fps, owners = (np.zeros(0, np.int64) for _ in range(3))

        def edges(keys, fps, owners):
            cuts = np.flatnonzero(np.diff(keys)) + 1
            from_, to = [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if hi - lo > 1:
                    for root, others in forest(fps[lo:hi].view(np.uint64), owners[lo:hi], radius):
                        from_.append(np.full(len(others), root))
                        to.append(others)
            if to:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), pa.array(np.concatenate(from_))], ["u", "v"])

        for b in batches:
            k, f, o = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            keys, fps, owners = np.concatenate([keys, k]), np.concatenate([fps, f]), np.concatenate([owners, o])
            if not len(keys) or keys[0] == keys[-1]:
                continue
            whole = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            yield from edges(keys[:whole], fps[:whole], owners[:whole])
            keys, fps, owners = keys[whole:], fps[whole:], owners[whole:]
        if len(keys):
            yield from edges(keys, fps, owners)

    return scan


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``edges`` (u, v) can reach, for nodes that are not their own root.
    Alternates large stars and small stars until the edges stay as they are."""

    def hooked(e: DataFrame, least: DataFrame) -> DataFrame:
        """``e`` beside the least neighbour of u: the neighbours of a hub are cut by v, and its one row of ``least`` goes to each cut."""
        salted = e.withColumn("way", F.pmod(F.xxhash64("v"), F.lit(HUB_WAYS)).cast("int"))
        hubs = least.filter(F.col("n") > HUB)
        ways = F.explode(F.when(F.col("n") > HUB, F.sequence(F.lit(0), F.lit(HUB_WAYS - 1))).otherwise(F.array(F.lit(-1)))).alias("way")
        marked = salted.join(F.broadcast(hubs.select("u", F.lit(True).alias("hub"))), "u", "left")  # one for each HUB edges at most
        marked = marked.withColumn("way", F.when(F.col("hub"), F.col("way")).otherwise(F.lit(-1))).drop("hub")
        return marked.join(least.select("u", "m", ways), ["u", "way"]).drop("way")

    def neighbours(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))

    def larger_first(e: DataFrame) -> DataFrame:
        return e.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now, before = materialise(larger_first(edges), "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the least neighbour
        large = hooked(both, neighbours(both).withColumn("m", F.least("u", "m"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(larger_first(large), "large-star")
        # small star: the node and its smaller neighbours go to the least of them
        least = neighbours(large)
        small = hooked(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        then = materialise(larger_first(small), "small-star")
        discard(large)
        discard(now)
        now, before = then, state


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (the 64 bits as a signed long) for each row. Null, empty and blank texts: 0."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "id long, fp long")


def link(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, component`` for each distinct fingerprint of ``prints`` (id, fp): the smallest id that links reach."""
    spark = prints.sparkSession
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("owner")), "fingerprints")
    named = distinct.filter(F.col("owner").isNotNull())
    n = named.count()
    counts = named.select("fp").mapInArrow(_together, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 64 x 64
    together = np.zeros((64, 64))
    for i, j, c in counts:
        together[i, j] = c
    part = F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))
    sample = np.array([r["fp"] for r in named.filter(part).select("fp").limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)
    scheme = plan(together, n, sample, radius)
    dealt = named.select("fp", "owner").mapInArrow(_dealt(scheme), "key long, fp long, owner long")
    hot = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP)
    hot = hot.select("key", F.ceil(F.col("n") / (GROUP // 2)).cast("int").alias("blocks"))
    hot = materialise(hot, "hot-keys")
    rows = dealt
    if hot.head(1):  # at most one row for each GROUP dealt rows
        own = F.pmod(F.xxhash64("fp"), "blocks").cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.xxhash64("key", F.least(b, own), F.greatest(b, own)))
        rows = dealt.join(F.broadcast(hot), "key", "left").select(F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "fp", "owner")
    edges = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_linked(radius), "u long, v long")
    found = components(edges)
    return distinct.join(found, F.col("owner") == F.col("node"), "left").select("fp", F.coalesce("root", "owner").alias("component"))


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``id, fp, component``: one row for each row of ``df``, with the smallest id reachable over links of its fingerprint.

    Texts without words have fingerprint 0 and link like any other. Rows of equal fingerprint are linked, so repeated rows
    share a component. Rows with a null id take part through the fingerprint they share with others; where it has no id at
    all, the component is null. An empty table gives an empty result. Other columns are not read."""
    return grouped(materialise(fingerprints(df, id_col, text_col), "simhash"), radius)


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``id, fp, component`` for each row of ``prints`` (id, fp), a table that is read several times."""
    found = link(prints, radius)
    # a fingerprint may be that of a third of all rows: its rows are cut by id, and its one component goes to each cut
    many = materialise(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB).select("fp", F.lit(True).alias("many")), "common-fingerprints")
    few = F.broadcast(many)  # one row for each HUB rows at most
    way = F.when(F.col("many"), F.pmod(F.xxhash64("id"), F.lit(HUB_WAYS)).cast("int")).otherwise(F.lit(-1)).alias("way")
    ways = F.explode(F.when(F.col("many"), F.sequence(F.lit(0), F.lit(HUB_WAYS - 1))).otherwise(F.array(F.lit(-1)))).alias("way")
    rows = prints.join(few, "fp", "left").select("id", "fp", way)
    return rows.join(found.join(few, "fp", "left").select("fp", "component", ways), ["fp", "way"], "left").select("id", "fp", "component")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash_groups(documents(spark, sf_dir))
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
