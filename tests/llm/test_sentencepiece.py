import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import sentencepiece_scan as m

PATH = m.default_model_path()
V, PIECES = m.Vocabulary(PATH), m.spellings(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
POOL = ["the", " ", "  ", "   ", "\n", "é", "日", "😀", "aaaa", "----", "=", m.MARK, "tion", "x", "1", "\t", "ﬁ", "internationalisation", " " * 9, "." * 16, "ab", "AAAA", "²."]


def by_chunks(text, size, fan):
    """Matrices of chunks, products of blocks up and ways down, each chunk traced for itself."""
    t, chunks, shifts = m.marked(text), [], []
    for k in range(-(-len(t) // size)):
        shift = max(0, k * size - V.longest)
        chunks.append((t[shift : (k + 1) * size + V.longest], k * size - shift, min(len(t), (k + 1) * size) - shift))
        shifts.append(shift)
    found = V.transfers(chunks)
    levels = [[m._matrix_of(m._cells(matrix, s)) for (_, _, matrix), s in zip(found, shifts, strict=True)]]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([m.functools.reduce(m.product, last[a : a + fan]) for a in range(0, len(last), fan)])
    way = [((-1, 0), (len(t), len(t)), 0)]
    assert (levels[-1][0].keys(), levels[-1][0][-1, 0].keys()) == ({(-1, 0)}, {(len(t), len(t))})
    for level in reversed(levels[:-1]):
        way = [w for k, (i, j, n) in enumerate(way) for w in m.way_through(level[k * fan : (k + 1) * fan], i, j, n)]
    ids = []
    for (part, _, _), shift, (cuts, inner, _), (i, j, before) in zip(chunks, shifts, found, way, strict=True):
        assert before == len(ids)
        own = lambda s: (s[0] - shift if s[0] >= 0 else -1, s[1] - shift)  # noqa: E731, B023
        head, tail = (part, "") if cuts is None else (part[: cuts[0]], part[cuts[1] :])
        before, after = V.trace(head, tail, cuts, own(i), own(j))
        ids += np.frombuffer(before + inner + after, "<i4").tolist()
    return ids


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(POOL), max_size=40).map("".join) | st.text(max_size=40))
def test_ids_equal_the_librarys(text):
    if text:
        assert by_chunks(text, 1 << 13, 64) == LIBRARY.encode(text)
    ids = np.frombuffer(V.encode_texts([m.marked(text)])[0], "<i4").tolist()
    assert ids == LIBRARY.encode(text)
    assert m.decode(PIECES, ids) == text.replace(m.MARK, " ")


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(POOL), min_size=1, max_size=60).map("".join), st.integers(32, 90), st.integers(2, 4))
def test_chunks_join_to_the_whole(text, size, fan):
    assert by_chunks(text, size, fan) == LIBRARY.encode(text)


@pytest.mark.parametrize("unit", ["-", " ", "a", "ab", "=-", "日", "1", "²", "aA"])
def test_texts_without_cuts(unit):
    text = unit * (3 * m.CHUNK // len(unit) + 5)
    assert by_chunks(text, m.CHUNK, m.FAN) == LIBRARY.encode(text)


def test_product_is_associative():
    rng = random.Random(1)
    a, b, c = ({(i, i): {(j, j): rng.randint(0, 9) for j in range(5) if rng.random() < 0.6} for i in range(5)} for _ in range(3))
    assert m.product(m.product(a, b), c) == m.product(a, m.product(b, c))


def check_rows(df, texts, **options):
    encoded = m.encode(df, PATH, **options)
    got = m.decode_ids(encoded, PATH).collect()
    assert m.encode(df, PATH, decoded=True, **options).exceptAll(m.decode_ids(encoded, PATH)).count() == 0
    for r in got:
        t = "no id" if r["id"] is None else texts[r["id"]] or ""
        assert r["ids"] == LIBRARY.encode(t) and r["decoded"] == t
        assert r["n_chunks"] == max(1, -(-(len(t) + 1) // options.get("chunk", m.CHUNK)) if t else 1)
    return got


@pytest.mark.parametrize(("fan", "at_once", "remembered"), [(2, 256, 1000), (64, 7, 5)])
def test_rows(spark, monkeypatch, fan, at_once, remembered):
    monkeypatch.setattr(m, "AT_ONCE", at_once)
    monkeypatch.setattr(m, "REMEMBERED", remembered)  # the second forgets all the time
    rng = random.Random(2)
    texts = {i: "".join(rng.choices(POOL, k=rng.randint(0, 60))).replace(m.MARK, "") for i in range(40)} | {40: None, 41: "", 42: "x" * 700, 43: "word " * 300}
    df = spark.createDataFrame([(i, t, [1]) for i, t in texts.items()] + [(43, texts[43], [1]), (None, "no id", [1])], "doc_id long, text string, ids array<int>").repartition(3)
    assert len(check_rows(df, texts, chunk=33, fan=fan)) == len(texts) + 2
    assert m.encode(df.limit(0), PATH).count() == 0


def test_default_chunks(spark):
    words = "Some ordinary prose, with Ünïcode; numbers 12345 and ▁marks? ".replace(m.MARK, "")
    texts = {1: words * 2000, 2: "-" * 30_000, 3: " " * 20_000 + words, 4: "b" * (m.CHUNK - 1), 5: "b" * m.CHUNK, 6: words}
    df = spark.createDataFrame(list(texts.items()) + [(1, texts[1])], "doc_id long, text string").repartition(2)
    assert sum(r["n_chunks"] > 1 for r in check_rows(df, texts)) == 5
    for bad in ({"chunk": 20}, {"fan": 1}):
        with pytest.raises(ValueError, match="shorter than two"):
            m.encode(df, PATH, **bad)


def test_registered_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in m.op3_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and sum(r["n_chunks"] > 1 for r in got.values()) > 30
    for r in docs:
        assert got[r["doc_id"]]["ids"] == LIBRARY.encode(r["text"] or "")
