import zlib

import numpy as np

from tilewright.llm import language_id as m

WORDS = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "żółty kwiat rośnie nad rzeką wśród traw", "cc": "the brown fox jumps over lazy dogs"}


def table(spark, n=120):
    rows = [(i, " ".join(WORDS[lang].split()[(i + k) % 5] for k in range(12)), lang, "s") for i, lang in enumerate(sorted(WORDS) * (n // 3))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy_and_what_the_fit_sees(spark):
    docs = table(spark)
    got = {r["id"]: r for r in m.predict(docs, m.fit_documents(docs)).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["lang_pred"] == r["lang"] and 0 <= got[r["doc_id"]]["score"] <= 1
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", m.held_out("doc_id").alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in flags.items())
    changed = docs.withColumn("lang", m.F.when(m.held_out("doc_id"), "zz").otherwise(m.F.col("lang")))
    assert m.fit_documents(changed).languages == sorted(WORDS)


def test_texts_without_letters_and_odd_tables(spark):
    model = m.fit_documents(table(spark))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- 3!"), (4, "…—"), (5, "Z"), (None, "the lazy dogs"), (6, "쐐"), (7, "the fox " * 60_000)], "doc_id long, text string")
    got = {r["id"]: r["lang_pred"] for r in m.predict(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[None] == "cc" and got[7] == "cc"
    assert got[5] in WORDS and got[6] in WORDS
    assert m.predict(odd.limit(0), model).count() == 0
    empty = m.fit_documents(table(spark).limit(0))
    assert {r["lang_pred"] for r in m.predict(odd, empty).collect()} == {"und"}


def test_false_positives_are_corrected():
    slots = np.full((1 << m.SLOT_BITS, 1), 1, np.uint64)  # a slice that always says yes tells nothing
    slots[: 1 << m.SLOT_BITS - 1] |= np.uint64(2)
    model = m.Model(["aa", "bb"], slots, np.array([0.999999, 0.25]), "aa")
    r = m.rates(model, [m.folded("some words of any kind at all")])
    assert r.shape == (1, 2) and (r >= 0).all() and (r <= 1).all()


def test_many_languages_use_several_planes(spark):
    rows = [(i, chr(0x4E00 + 40 * (i % 70)) * 3 + chr(0x4E01 + 40 * (i % 70)) * 4, f"l{i % 70:02d}") for i in range(420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["id"]: r["lang_pred"] for r in m.predict(docs, m.fit_documents(docs)).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 0.95 * len(rows)


def test_blocks_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(1).withColumn("text", m.F.repeat("text", 400)).withColumn("doc_id", m.F.lit(10**6).cast(docs.schema["doc_id"].dataType)))
    model = m.fit_documents(docs)
    whole = sorted(map(tuple, m.predict(docs, model).collect()))
    texts = [f for r in docs.limit(40).collect() if (f := m.folded(r["text"]))]
    rates = m.rates(model, texts)
    for block in (1, 7, 1000):
        monkeypatch.setattr(m, "BLOCK", block)
        few = texts[:3] if block == 1 else texts
        assert (m.rates(model, few) == rates[: len(few)]).all()
    again = m.fit_documents(docs)
    assert (again.slots == model.slots).all() and sorted(map(tuple, m.predict(docs, again).collect())) == whole
