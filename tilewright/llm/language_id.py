"""Language ID with language-bitmask n-gram filters.

A bit-sliced Bloom filter: every slot holds one bit for each language, so the AND of a gram's few slots is the set of all
languages that contain it. A document's score for a language is the share of its grams whose mask has that language's
bit, corrected for the rate at which that language's slice answers yes to a gram it does not hold.

The filter is fitted on at most ``SAMPLE_DOCS`` labelled documents of each language (rows picked by a hash of their id),
and keeps the ``GRAMS`` most frequent grams of each. Its size is fixed, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ._common import documents, small_batches

#: Bounds of the fit: labelled documents and grams of each language.
SAMPLE_DOCS, GRAMS = 400, 6000
#: Slots of the filter (a power of two) and slots of a gram.
SLOT_BITS, PROBES = 18, 2
#: Grams that are looked up or counted at a time: bounds memory for texts of any length.
BLOCK = 1 << 20
NO_LANGUAGE = "und"
#: ASCII letters stay, other ASCII turns to blanks, other bytes stay.
_BLANKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass
class Model:
    languages: list[str]
    slots: np.ndarray  #: (2^SLOT_BITS, planes) uint64, bit l % 64 of plane l // 64 for language l
    false_rates: np.ndarray
    fallback: str


def folded(text: str | None) -> bytes | None:
    """Lower-case letters and blanks with a margin, so that every text with a letter has a gram; None without a letter."""
    if not text:
        return None
    b = text.lower().encode().translate(_BLANKS)
    if not b.strip() or (not any(97 <= c < 123 for c in set(b)) and not any(c.isalpha() for c in text)):
        return None
    return b" " + b + b"   "


def grams(joined: bytes) -> np.ndarray:
    """Every 4-byte gram as a number, one for each start."""
    a = np.frombuffer(joined, np.uint8).astype(np.uint32)
    return a[:-3] | a[1:-2] << 8 | a[2:-1] << 16 | a[3:] << 24


def slots_of(g: np.ndarray) -> list[np.ndarray]:
    return [(g * m ^ (g * m) >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - SLOT_BITS) for m in _MULTIPLIERS[:PROBES]]


def _blocks(texts: list[bytes]):
    """The grams of texts, some ``BLOCK`` at a time."""
    held, size = [], 0
    for t in texts:
        for at in range(0, len(t) - 3, BLOCK):
            held.append(grams(t[at : at + BLOCK + 3]))
            size += len(held[-1])
            if size >= BLOCK:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _count(batches):
    """Gram counts of each language within a block of a batch."""
    for b in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if (f := folded(text)) is not None:
                by.setdefault(lang, []).append(f)
        for lang, block in ((lang, block) for lang, parts in by.items() for block in _blocks(parts)):
            g, n = np.unique(block, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def fit(labelled: DataFrame) -> Model:
    """``labelled``: id, text, lang (not null). The languages are those it names."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("size")).collect()  # a row for each language
    if not sizes:
        return Model([], np.zeros((1 << SLOT_BITS, 1), np.uint64), np.zeros(0), NO_LANGUAGE)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, SAMPLE_DOCS / r["rows"]))])
    chosen = labelled.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    counts = chosen.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= GRAMS)
    table = top.select("lang", "gram").toPandas()  # at most GRAMS rows for each language
    languages = sorted(r["lang"] for r in sizes)
    slots = np.zeros((1 << SLOT_BITS, -(-len(languages) // 64)), np.uint64)
    for k, lang in enumerate(languages):
        for s in slots_of(table["gram"][table["lang"] == lang].to_numpy().astype(np.uint32)):
            slots[s, k // 64] |= np.uint64(1) << np.uint64(k % 64)
    fill = [(slots[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(languages))]
    most = max(sizes, key=lambda r: (r["rows"], r["lang"]))["lang"]
    return Model(languages, slots, np.array(fill) ** PROBES, most)


def rates(model: Model, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): the share of each text's grams that each language holds, corrected for false positives."""
    lengths, data = np.array([len(t) for t in texts]), b"".join(texts)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    across = np.concatenate([starts[1:] - back for back in (1, 2, 3)])  # grams that reach into the next text do not count
    hits = np.zeros((len(texts), len(model.languages)), np.int64)
    for at in range(0, len(data) - 3, BLOCK):
        g = grams(data[at : at + BLOCK + 3])
        first, last = np.searchsorted(starts, (at, at + len(g) - 1), "right") - 1
        own, out_of = np.maximum(starts[first : last + 1] - at, 0), across[(across >= at) & (across < at + len(g))] - at
        found = [slot for slot in slots_of(g)]
        for plane in range(model.slots.shape[1]):
            table = model.slots[:, plane]
            small = table.astype(np.uint8) if len(model.languages) <= 8 else table
            mask = small[found[0]]
            for slot in found[1:]:
                mask = mask & small[slot]
            mask[out_of] = 0
            for k in range(plane * 64, min(len(model.languages), plane * 64 + 64)):
                hits[first : last + 1, k] += np.add.reduceat(mask >> mask.dtype.type(k % 64) & mask.dtype.type(1), own, dtype=np.int64)
    out = hits / (lengths - 3)[:, None]
    false = model.false_rates
    return np.clip((out - false) / (1 - false), 0, 1)


def _predict(shared, first: str):
    def scan(batches):
        model = Model(*shared.value)
        for b in batches:
            texts = [folded(t) for t in b.column(1).to_pylist()]
            some = [k for k, t in enumerate(texts) if t is not None] if model.languages else []
            lang, score, fit_ = [NO_LANGUAGE] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            if some:
                r = rates(model, [texts[k] for k in some])
                best, total = r.argmax(axis=1), r.sum(axis=1)
                for row, k in enumerate(some):
                    top = r[row, best[row]]
                    lang[k] = model.languages[best[row]] if top > 0 else model.fallback
                    score[k] = float(top / total[row]) if top > 0 else 0.0
                    fit_[k] = float(top)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(fit_)], [first, "lang_pred", "score", "gram_share"])

    return scan


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, gram_share`` for each row. ``score``: the best language's part of all corrected shares;
    ``gram_share``: its corrected share itself. Null, empty and letterless texts: ``und``, 0. A text with letters whose grams
    are all unknown gets the most frequent language with score 0. Ties go to the language first in the alphabet. Repeated
    rows repeat, null ids stay, an empty table gives an empty result, other columns are not read."""
    return _predicted(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), model)


def with_language(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row, lang_pred, score, gram_share``: the same beside each whole row, as a struct whose names cannot clash. Rows stay where
    they are, so a filter on the prediction needs no join."""
    return _predicted(df.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), model)


def _predicted(rows: DataFrame, model: Model) -> DataFrame:
    """``rows``: anything, and the text."""
    spark = rows.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(astuple(model))  # 2^18 slots: a fixed size
    kind = StructType([rows.schema[0], *(StructField(n, t) for n, t in (("lang_pred", StringType()), ("score", DoubleType()), ("gram_share", DoubleType())))])
    return rows.mapInArrow(_predict(shared, rows.columns[0]), kind)


def held_out(id_col) -> F.Column:
    """Documents that the fit never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    small_batches(df.sparkSession)
    rows = df.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return fit(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, fit_documents(docs))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "gram_share")
