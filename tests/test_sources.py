import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import shape
from tilewright.operators import build
from tilewright.sources import binary, generate
from tilewright.streaming import continuous


def records(n):
    return b"".join(struct.pack("<ffffQ", i, i + 0.5, i + 1, i + 2, i) for i in range(n))


def test_reads_hand_packed_records(spark, tmp_path):
    f = tmp_path / "rects.bin"
    f.write_bytes(records(10))
    rows = binary.read_rects(spark, str(f)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(i, float(i), i + 0.5, i + 1.0, i + 2.0) for i in range(10)]


def test_trailing_bytes_empty_and_missing_files(spark, tmp_path):
    f = tmp_path / "rects.bin"
    f.write_bytes(records(3) + b"xyz")
    assert binary.read_rects(spark, str(f)).count() == 3
    with pytest.warns(UserWarning, match="3 trailing bytes"):
        binary.spans(str(f), 24, 10)
    f.write_bytes(b"")
    with pytest.raises(Exception, match="empty input"):
        binary.read_rects(spark, str(f)).count()
    with pytest.raises(Exception, match="No such file|nothing"):
        binary.read_rects(spark, str(tmp_path / "nothing")).count()


def test_written_records_are_in_id_order(spark, tmp_path):
    rects = generate.uniform_rects(spark, 1000)
    binary.write_rects(rects, str(tmp_path / "out"))
    raw = b"".join(open(f, "rb").read() for f in binary.files_of(str(tmp_path / "out")))
    a = np.frombuffer(raw, binary.RECORD)
    assert a["child"].tolist() == list(range(1000))
    assert binary.read_rects(spark, str(tmp_path / "out")).exceptAll(rects).count() == 0


def test_tree_file(spark, tmp_path):
    rects = generate.uniform_rects(spark, 700)
    index = build.build_index(rects, fill=0.05)
    binary.write_tree(index, str(tmp_path / "tree"))
    raw = b"".join(open(f, "rb").read() for f in binary.files_of(str(tmp_path / "tree")))
    assert len(raw) == (sum(index.pages) + 1) * shape.PAGE_BYTES
    head = dict(zip(binary.HEADER_NAMES, struct.unpack("<IIIIIIffQQQffff", raw[:72])))
    assert (head["magic"], head["num_rects"], head["root_page"], head["height"]) == (shape.MAGIC, 700, sum(index.pages), index.height)
    one = tmp_path / "tree.bin"
    one.write_bytes(raw)
    for path in (str(one), str(tmp_path / "tree")):
        loaded = binary.read_tree(spark, path)
        assert loaded.entries.exceptAll(index.entries).count() == 0 and loaded.entries.count() == index.entries.count()
        assert loaded.meta.first().asDict() == index.meta.first().asDict()
    one.write_bytes(b"\0" * 4096)
    with pytest.raises(ValueError, match="not a tree"):
        binary.read_header(str(one))


def test_generators(spark):
    a, b = generate.uniform_rects(spark, 5000), generate.uniform_rects(spark, 5000).repartition(7)
    assert a.exceptAll(b).count() == 0
    r = a.selectExpr("min(min_x)", "max(min_x)", "min(max_x - min_x)", "max(max_x - min_x)", "avg(min_y)").first()
    assert 0 <= r[0] and r[1] < 1000 and r[2] > 0.09 and r[3] < 10.01 and 480 < r[4] < 520
    c = generate.clustered_rects(spark, 5000, 5)
    assert c.filter("min_x < 0 or min_x > 1000 or min_y < 0 or min_y > 1000").count() == 0
    assert c.selectExpr("count(distinct floor(min_x / 50), floor(min_y / 50))").first()[0] < 100
    for bad in ((0, 1, 2), (5, 0, 2), (5, 3, 2)):
        with pytest.raises(ValueError):
            generate.uniform_rects(spark, bad[0], least=bad[1], most=bad[2])
    assert all(abs(r["max_x"] - r["min_x"] - 1) < 1e-6 for r in generate.unit_squares(spark, 50, 1.0).collect())


def test_stream_of_rectangles(spark, tmp_path):
    generate.uniform_rects(spark, 500).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(G.RECT_SCHEMA).parquet(str(tmp_path / "in"))
    box = (0.0, 0.0, 500.0, 500.0)
    q = continuous.continuous_range_query(stream, box).writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hits").count() == generate.uniform_rects(spark, 500).filter("min_x <= 500 and min_y <= 500").count()


def test_faulty_pages_and_overwriting(spark, tmp_path):
    index = build.build_index(generate.uniform_rects(spark, 300))
    binary.write_tree(index, str(tmp_path / "tree"))
    raw = bytearray(b"".join(open(f, "rb").read() for f in binary.files_of(str(tmp_path / "tree"))))
    one = tmp_path / "tree.bin"
    one.write_bytes(raw[:4096] + struct.pack("<I", 171) + raw[4100:])
    with pytest.raises(Exception, match="171 entries of at most 170"):
        binary.read_tree(spark, str(one)).entries.count()
    one.write_bytes(raw[: 4096 + 8 + 16] + struct.pack("<Q", 1 << 63) + raw[4096 + 32 :])
    with pytest.raises(Exception, match="2.63 or more"):
        binary.read_tree(spark, str(one)).entries.count()
    out = str(tmp_path / "rects")
    binary.write_rects(generate.uniform_rects(spark, 100), out)
    bad = generate.uniform_rects(spark, 50).withColumn("min_x", F.when(F.col("id") == 49, float("nan")).otherwise(F.col("min_x")))
    with pytest.raises(Exception, match="finite"):
        binary.write_rects(bad, out)
    assert binary.read_rects(spark, out).count() == 100  # a failed job leaves the earlier files
    binary.write_rects(generate.uniform_rects(spark, 70), out)
    assert binary.read_rects(spark, out).count() == 70


def test_standing_queries(spark, tmp_path):
    generate.uniform_rects(spark, 300).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(G.RECT_SCHEMA).parquet(str(tmp_path / "in"))
    queries = spark.createDataFrame([(0, 0.0, 0.0, 500.0, 500.0), (1, 900.0, 900.0, 901.0, 901.0)], "qid long, min_x double, min_y double, max_x double, max_y double")
    q = continuous.continuous_batch_query(stream, queries).writeStream.format("memory").queryName("standing").start()
    q.processAllAvailable()
    q.stop()
    want = {(k, r["id"]) for r in generate.uniform_rects(spark, 300).collect() for k, (a, b) in enumerate([(0, 500), (900, 901)]) if r["min_x"] <= b and r["max_x"] >= a and r["min_y"] <= b and r["max_y"] >= a}
    assert {tuple(r) for r in spark.table("standing").collect()} == want
    with pytest.raises(ValueError, match="standing queries"):
        continuous.continuous_batch_query(stream, queries, most=1)
