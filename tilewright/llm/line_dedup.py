"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

A run is a table of 128-bit line hashes, each with its owner, the smallest document that holds it; it is bucketed and
sorted by hash, so a merge anti join against it moves only the new batch. Batches come in ascending id order: a batch's
hashes that no run holds get their owner from the batch and form a run of their own. ``FAN_IN`` runs of one level are
compacted into a run of the next. A line stays iff its document owns its hash, which is again an anti join, by hash and
document: no key of it is hot, however common a line is.
"""

from __future__ import annotations

import atexit
import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import _remove, ascii_lower, discard, documents, materialise, written_bytes

#: Fewest batches that a whole table is added in, and runs of a level that are compacted into one.
BATCHES, FAN_IN = 3, 2
#: Bytes of line hashes for each bucket of a run, and bytes of input that take one more batch each time they double.
BUCKET_BYTES, DOUBLED_BYTES = 64 << 20, 1 << 30
#: Code points that a line's key needs to take part.
MIN_KEY = 10
BLANKS = " \t\n\x0b\x0c\r"
_tables: list[tuple[SparkSession, str]] = []


@atexit.register
def _drop_all() -> None:
    for spark, name in _tables:
        try:
            if spark.sparkContext._jsc is not None:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the JVM is already gone
            return


class LineStore:
    """Levels of sorted runs, each run bucketed by hash.

    Without ``folder`` the runs are tables of the warehouse that go when the driver ends. With it, runs and a manifest of them are kept
    in that folder (shared storage), and a store that a later driver opens there goes on from the last whole manifest: a run that
    was written without its manifest does not count, and merged runs go only after the manifest that no longer names them."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, folder: str | None = None):
        self.spark, self.fan_in, self.folder = spark, fan_in, folder and folder.rstrip("/")
        self.buckets: int | None = None
        self.levels: list[list[str]] = []
        self.version = 0
        if self.folder:
            self._open()

    def _open(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest-*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        versions = [int(f.getPath().getParent().getName().rpartition("-")[2]) for f in found]
        if not versions:
            return
        self.version = max(versions)
        kept = json.loads(self.spark.read.text(f"{self.folder}/manifest-{self.version}").first()["value"])
        self.buckets, self.levels = kept["buckets"], kept["levels"]
        for name in (name for level in self.levels for name in level):
            _tables.append((self.spark, name))
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} (h1 BIGINT, h2 BIGINT, owner BIGINT) USING parquet "
                f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'"
            )

    def _commit(self) -> None:
        if self.folder:
            kept = json.dumps({"buckets": self.buckets, "levels": self.levels})
            self.spark.createDataFrame([(kept,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest-{self.version + 1}")
            self.version += 1

    def size_for(self, n_bytes: int) -> None:
        """Buckets of a new store, by the bytes of the first hashes; those of an opened store stay as they are."""
        self.buckets = self.buckets or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        _tables.append((self.spark, name))
        out = rows.select("h1", "h2", "owner").repartition(self.buckets, "h1", "h2").write.format("parquet").option("compression", "zstd")
        if self.folder:
            out = out.option("path", f"{self.folder}/{name}")
        out.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        _tables.remove((self.spark, name))
        if self.folder:
            _remove(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """``keys``: h1, h2, owner, one row for each hash. Returns the new run: those that no earlier run holds."""
        self.size_for(0)
        for run in self.runs():
            keys = keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        name = self._write(keys)
        fresh = self.spark.table(name)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        self._commit()
        return fresh

    def compact(self) -> None:
        """Merge the runs of each full level into one run of the next."""
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fan_in:
                names, self.levels[k] = self.levels[k], []
                merged = self._write(functools.reduce(DataFrame.unionByName, [self.spark.table(n) for n in names]))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)
                self._commit()
                for n in names:
                    self._drop(n)


def line_key(line) -> F.Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def split_lines(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(rows: DataFrame) -> DataFrame:
    """``id, text_hash, pos, h1, h2`` of every line that takes part. ``rows``: id, text."""
    key = line_key(F.col("line"))
    lines = rows.filter(F.col("id").isNotNull()).select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("id", "text_hash", "pos", key.alias("key")).filter(F.length("key") >= MIN_KEY)
    return lines.select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def dropped_lines(lines: DataFrame, fresh: DataFrame) -> DataFrame:
    """Lines whose document does not own their hash. The key of the join holds the document, so copies spread."""
    owned = fresh.select("h1", "h2", F.col("owner").alias("id"))
    return lines.join(owned, ["h1", "h2", "id"], "left_anti")


def batch_count(rows: DataFrame) -> int:
    """Grows with the logarithm of the input: every batch reads all runs before it, so batches of one size would make the work quadratic.
    The bytes are the plan's estimate, and as many as none where it has none; they decide the cost only."""
    n_bytes = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return BATCHES + (n_bytes // DOUBLED_BYTES).bit_length() if n_bytes < 1 << 60 else BATCHES


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None, store: LineStore | None = None) -> DataFrame:
    """``id, kept, n_lines, n_dropped``: each text without the lines that a document of smaller id holds.

    Texts are read twice, whatever the number of batches: one pass deals the hashes of all lines by batch, one takes lines out. Null and
    empty texts are one empty line. Lines whose key is shorter than ten code points always stay, as do lines repeated only within their
    document. Rows with a null id keep all lines and own none. Rows that repeat an id count as one document. An empty table gives an
    empty result. Columns other than the two named are not read.

    With a ``store`` that earlier calls have filled, who came first owns a line: documents lose what the store holds, also if their ids are
    smaller, and a document that is added again is a copy of itself."""
    spark = df.sparkSession
    store = store or LineStore(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    batches = batches or batch_count(rows)
    cuts = rows.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10_000).alias("cuts")).first()["cuts"] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    batch = functools.reduce(lambda a, c: a + (F.col("id") > c).cast("int"), cuts, F.lit(0))
    dealt = materialise(line_hashes(rows).withColumn("batch", batch), "lines", "batch")
    store.size_for(written_bytes(dealt) // (len(cuts) + 1))
    dropped = []
    for k in range(len(cuts) + 1):
        lines = dealt.filter(F.col("batch") == k).drop("batch")
        fresh = store.add(lines.groupBy("h1", "h2").agg(F.min("id").alias("owner")))
        dropped.append(materialise(dropped_lines(lines, fresh).select("id", "text_hash", "pos"), "dropped-lines"))
        store.compact()
    discard(dealt)
    at = functools.reduce(DataFrame.unionByName, dropped)
    # positions as sparse 64-bit words: looking a line up does not walk all dropped lines of its text
    words = at.groupBy("id", "text_hash", F.expr("pos div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    words = words.groupBy("id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    texts = rows.withColumn("text_hash", F.xxhash64("text")).join(words, ["id", "text_hash"], "left")
    lines = split_lines(F.col("text"))
    gone = F.expr("filter(lines, (x, i) -> coalesce(getbit(try_element_at(words, cast(i div 64 as bigint)), i % 64), 0) = 0)")
    texts = texts.select("id", "words", lines.alias("lines")).select("id", F.size("lines").alias("n_lines"), F.when(F.col("words").isNull(), F.col("lines")).otherwise(gone).alias("stay"))
    return texts.select("id", F.array_join("stay", "\n").alias("kept"), F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.size("stay")).cast("long").alias("n_dropped"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup(documents(spark, sf_dir))
    return d.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), j AS (SELECT doc_id, pos, line, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
