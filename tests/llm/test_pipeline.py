import random

import pytest

import corpus_pipeline as c
from tilewright.llm import exact_dedup, near_copies, secret_scan
from tilewright.llm._common import materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the quick brown fox jumps over a lazy dog near some river bank", "fr": "le renard brun saute par dessus un chien paresseux près du fleuve"}


def corpus(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(20, 60))) + ".", lang, "s") for i, lang in enumerate(["en", "fr"] * 40)]
    rows += [(100, rows[4][1].upper(), "en", "s"), (101, " ".join(rng.choices(WORDS["fr"].split(), k=40)) + " password = hunter22secret", "fr", "s"), (105, rows[5][1] + " la fin", "fr", "s"), (102, "12345 --- !!!", "en", "s"), (103, None, "en", "s"), (104, "", None, None), (None, "the fox without an id", "en", "s"), (4, rows[4][1], "en", "s")]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA).repartition(3)


def stages(spark, docs):
    out = []
    for name, stage in c.STAGES:
        docs = materialise(stage(spark, docs, None), name)
        out.append(docs)
    return out


def test_each_stage_takes_effect_and_keeps_the_columns(spark):
    docs = corpus(spark)
    language, exact, near, secrets, packed = stages(spark, docs)
    for out in (language, exact, near, secrets):
        assert out.columns == docs.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(docs) - ids(language) == {102, 103, 104}
    kept = {r["id"] for r in exact_dedup.content_sort_dedup(language).filter("kept").collect()}
    assert ids(exact) == kept and 100 not in kept and 4 in kept
    assert exact.filter("doc_id = 4").count() == 1
    assert ids(near) == near_roots(exact)
    assert 101 in ids(near) and 105 in ids(exact) - ids(near)
    assert ids(secrets) == ids(near)
    for r in secrets.collect():
        assert "hunter22" not in r["text"] and r["n_chars"] == len(r["text"])
    assert not [r for r in secret_scan.secret_spans(secrets).collect() if r["base"]]
    assert ids(packed) == ids(secrets)
    clean = {r["doc_id"]: r["text"] for r in near.collect()}
    assert {r["doc_id"]: r["text"] for r in secrets.collect() if r["doc_id"] != 101} == {i: t for i, t in clean.items() if i != 101}


def near_roots(df):
    """The smallest id of each set of documents that similarities of 0.8 link, by all pairs."""
    rows = sorted(((r["doc_id"], set(near_copies.shingle_set(r["text"].encode()).tolist())) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    root = list(range(len(rows)))
    for k, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:k]):
            if len(a & b) >= 0.8 * len(a | b):
                old, new = max(root[j], root[k]), min(root[j], root[k])
                root = [new if r == old else r for r in root]
    return {rows[k][0] for k in set(root)}


def test_near_copies_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r["doc_id"] for r in c.drop_near_copies(spark, docs, None).collect()} == near_roots(docs)


def test_clashing_columns_and_very_long_texts(spark):
    long_ = " ".join(random.Random(1).choices(WORDS["en"].split(), k=60_000))
    rows = [(1, long_, "en", 3, "r", "k", 0.5), (2, long_ + " end", "en", 3, "r", "k", 0.5), (3, WORDS["en"], "en", 3, "r", "k", 0.5), (3, WORDS["en"].upper(), "en", 3, "r", "k", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int, row string, key string, score double")
    *kept, packed = stages(spark, docs)
    assert all(d.columns == docs.columns for d in kept)
    assert sorted((r["doc_id"], len(r["text"])) for r in kept[-1].collect()) == [(1, len(long_)), (3, len(WORDS["en"]))]
    assert {r["doc_id"] for r in packed.collect()} == {1, 3}


def test_empty_table(spark):
    assert [d.count() for d in stages(spark, corpus(spark).limit(0))] == [0] * 5


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    language = c.identify_language(spark, docs, None)
    assert language.count() == docs.count()


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_run(spark, sf):
    out = c.run(spark, f"/root/testdata/{sf}")
    rows = out.collect()
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
