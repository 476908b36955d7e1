import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tilewright.llm import packing as m

FOLDER = m.default_vocabulary_folder()


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dims))).T
        key = m.hilbert(grid, bits)
        assert sorted(key) == list(range(1 << bits * dims))
        steps = np.abs(np.diff(grid[:, np.argsort(key)], axis=1)).sum(axis=0)
        assert (steps == 1).all()


@pytest.mark.parametrize("text", ["", " ", "a", "don't 'LL", "<|endoftext|> x", "日本語 é ​", "\r\n\t  x\x1c\x85", "1234567 ½", "ab" * 3000, " " * 3000, "😀👨‍👩‍👧"])
def test_ids_equal_those_of_the_tokenizers_file(text):
    e = m.Encoder(FOLDER)
    assert e(text).tolist() == e.exact.encode(text, add_special_tokens=False).ids


def check(pieces, texts):
    e = m.Encoder(FOLDER)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = [*e(texts[i] or "").tolist(), 0]
        own.sort(key=lambda p: p["start"])
        joined = [x for p in own for x in np.frombuffer(p["ids"], "<u4").tolist()]
        assert joined == ids and [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1]]
        assert all(p["doc_tokens"] == len(ids) for p in own)
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        sizes = [p["length"] for p in own]
        assert [p["offset"] for p in own] == [0, *np.cumsum(sizes)[:-1]]
        assert sum(sizes) <= m.MAX_TOKENS and sum(sizes) & (sum(sizes) - 1) == 0  # full, or a power of two: no padding


def test_every_id_lies_in_one_piece(spark):
    texts = {i: " ".join(f"w{(i * k) % 97}" for k in range(i * 3 % 700)) for i in range(90)} | {90: None, 91: "", 92: "long " * 4000}
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in texts.items()], "doc_id long, text string, key int, ids string")
    check(m.pack(df, FOLDER, partitions=3).collect(), texts)


def test_null_id_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "same"), (1, "same")], "doc_id long, text string")
    rows = m.pack(df, FOLDER, partitions=2).collect()
    e = m.Encoder(FOLDER)
    assert sum(r["length"] for r in rows if r["id"] is None) == len(e("a b")) + 1
    assert sum(r["length"] for r in rows if r["id"] == 1) == 2 * (len(e("same")) + 1)
    assert m.pack(df.limit(0), FOLDER).count() == 0


def test_near_texts_lie_near_on_the_curve():
    a = [b"the quick brown fox jumps over the lazy dog again and again " * 20, b"der schnelle braune fuchs springt immer wieder hin und her " * 20]
    near = [t[:-40] + b"!" for t in a]
    p = m.points_of([*a, *near])
    assert np.linalg.norm(p[0] - p[2]) < np.linalg.norm(p[0] - p[1]) and np.linalg.norm(p[1] - p[3]) < np.linalg.norm(p[0] - p[1])


def test_registered_query(spark):
    from tilewright.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    found = QUERIES["op1_packing"](spark, sf).collect()
    e = m.Encoder(FOLDER)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in found:
        ids = np.append(e(texts[r["doc_id"]] or ""), 0).astype("<u4")
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)
    assert sum(r["length"] for r in found) == sum(len(e(t or "")) + 1 for t in texts.values())


def test_very_long_lines_of_ends_and_bounds_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(m, "PART_BYTES", 20_000)
    monkeypatch.setattr(m, "MOST_SAMPLES", 10)
    texts = {i: f"text {i} " * (i % 50) for i in range(200)} | {500: "\n" * 600_000, 501: "x" * 300_000}
    pieces = m.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), FOLDER)
    assert pieces.rdd.getNumPartitions() > 30
    check(pieces.collect(), texts)
