import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import suffix_dedup as m


def made_texts(seed: int, n: int = 60) -> dict[int, bytes]:
    """Texts that share passages of every length around the least one, with copies, near copies, and runs of one letter."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghé", k=rng.randint(1, 9))) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=60))[: rng.randint(45, 200)] for _ in range(6)]
    out: dict[int, str] = {}
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and out:
            text = rng.choice(list(out.values()))
        elif kind < 0.3 and out:
            text = list(rng.choice(list(out.values())))
            for _ in range(min(3, len(text))):
                text[rng.randrange(len(text))] = "z"
            text = "".join(text)
        else:
            text = " ".join([*rng.choices(words, k=rng.randint(0, 30)), rng.choice([rng.choice(passages), "", "a" * rng.randint(0, 150)]), *rng.choices(words, k=rng.randint(0, 30))])
        out[i * 3] = text
    return {i: t.encode() for i, t in out.items()}


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, kmer string, id int").repartition(5)
    return m.suffix_dedup(df)


def results(spark, texts):
    rows = run(spark, [(i, t.decode(), "x", 1) for i, t in texts.items()]).collect()
    return {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows}


@pytest.mark.parametrize(("seed", "changes"), [
    (1, {}), (2, {"HOT": 3}), (2, {"HOT": 3, "KMER_BITS": 3 << 62}), (3, {"BLOCK": 7}),
    (4, {"CONTEXT_BITS": 0}), (5, {"CONTEXT_BITS": 7, "KMER_BITS": 15 << 60}),  # hashes that collide all the time
])
def test_equals_a_dictionary_of_all_windows(spark, monkeypatch, seed, changes):
    for name, value in changes.items():
        monkeypatch.setattr(m, name, value)
    texts = made_texts(seed)
    assert results(spark, texts) == m.brute_force(texts)


def test_very_long_texts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(5000)]
    long_ = " ".join(rng.choices(words, k=60_000))
    texts = {1: long_[50_000:90_000], 2: long_, 3: "x" * 100_000, 4: "x" * 70_000 + long_[:1000], 5: long_ + "."}
    texts = {i: t.encode() for i, t in texts.items()}
    assert results(spark, texts) == m.brute_force(texts)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 2), st.integers(-40, 400)), max_size=40), st.integers(50, 400))
def test_runs_cover_what_their_anchors_cover(rows, n):
    rows = [(a, (o, 0, oat)) for a, o, oat in rows if a + m.KMER <= n]
    runs = m.settled_runs([a for a, _ in rows], [o for _, o in rows], n)
    cover = lambda a: range(max(0, a - m.BEFORE), min(n, a + m.MATCH))
    assert {(o[0], p, p + o[2] - a) for a, o in rows for p in cover(a)} == {(oid, start + k, ostart + k) for start, length, oid, _, ostart in runs for k in range(length)}
    assert all(ostart // m.BLOCK == (ostart + length - 1) // m.BLOCK for _, length, _, _, ostart in runs)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.sampled_from([b"a", b"b", b"c"]), st.integers(0, 3)), max_size=40), st.lists(st.integers(0, 40), max_size=3))
def test_windows_over_borders(rows, cuts):
    rows, bounds = sorted(rows), sorted({0, 40, *cuts})
    found = []
    for lo, hi in zip(bounds, bounds[1:]):
        part = rows[lo:hi]
        b = pa.RecordBatch.from_arrays([pa.array([i for _, i in part], pa.int64()), pa.array([0] * len(part), pa.int64()), pa.array(range(lo, lo + len(part)), pa.int32()), pa.array([w for w, _ in part], pa.binary())], list("abcd"))
        found += [r for x in m._neighbours(iter([b])) for r in x.to_pylist()]
    least = {}
    for r in found:
        if r["border"] is not None:
            least[r["border"]] = min(r["owner"], least.get(r["border"], r["owner"]))
    got = {r["start"] for r in found if r["border"] is None or r["id"] > least[r["border"]]}
    assert got == {k for k, (w, i) in enumerate(rows) if i > min(j for v, j in rows if v == w)}


def test_null_empty_and_repeated_rows(spark):
    long_ = "the same long passage of words that goes well beyond fifty bytes in length"
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, long_, "a", 1), (3, long_, "a", 1), (None, long_, "a", 1), (4, long_ + " more", "a", 1), (5, "short", None, None)]
    found = sorted((r["id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).decode()) for r in run(spark, rows).collect())
    n = len(long_)
    assert found == [(0, n, 0, 0, long_), (1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, n, 0, 0, long_), (3, n, 0, 0, long_), (4, n + 5, n, 1, " more"), (5, 5, 0, 0, "short")]
    assert run(spark, []).count() == 0


def test_every_window_has_an_anchor_of_its_content():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 400).astype(np.uint8)
    starts = np.arange(len(text) - m.KMER + 1)
    at = set(m.anchors(m.PrefixHashes(text, 12345 * 2 + 1)(starts, starts + m.KMER)).tolist())
    for s in range(len(text) - m.MATCH + 1):
        assert any(a in at for a in range(s, s + m.BEFORE + 1))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 3), st.binary(min_size=6, max_size=6)), min_size=1, max_size=40))
def test_suffix_order_sorts_and_measures(rows):
    rows.sort(key=lambda r: r[0])
    group = np.array([g for g, _ in rows])
    symbols = np.array([[b % 3 for b in t] for _, t in rows])
    order = m.SuffixOrder(symbols, group)
    as_lists = [(group[k], symbols[k].tolist()) for k in order.order]
    assert as_lists == sorted(as_lists)
    for k in range(1, len(rows)):
        same_group = as_lists[k][0] == as_lists[k - 1][0]
        common = next((j for j, (a, b) in enumerate(zip(as_lists[k][1], as_lists[k - 1][1])) if a != b), 6)
        assert order.common[k] == (common if same_group else -1)


def test_collisions_fall_back_to_bytes(monkeypatch):
    monkeypatch.setattr(m, "_BASE", 1)  # sums of symbols: permutations collide
    symbols = np.array([[2, 1, 3], [1, 2, 3], [3, 2, 1], [1, 3, 2]])
    order = m.SuffixOrder(symbols, np.zeros(4, int))
    assert symbols[order.order].tolist() == sorted(symbols.tolist())


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 2), st.integers(0, 3), st.integers(0, 4)), max_size=50), st.integers(1, 7))
def test_settling_does_not_depend_on_batches(rows, size):
    rows = sorted((k, 0 if k else s, c, i) for k, s, c, i in rows)
    kmer, salt, context, ids = (np.array([r[j] for r in rows], np.int64) for j in range(4))

    def result(step):
        parts = [slice(a, a + step) for a in range(0, len(rows), step)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c[p]) for c in (kmer, salt, context, ids, ids, np.arange(len(rows)))], list("abcdef")) for p in parts]
        return sorted((r["kmer"], r["id"], r["at"], r["oid"] is not None, r["oid"] or 0, r["oat"] or 0) for b in m._settle(iter(batches)) for r in b.to_pylist())

    assert result(size) == result(1000)
    first = {}
    for k, s, c, i in rows:
        first[k, s, c] = min(i, first.get((k, s, c), i))
    settled = [(k, i) for k, s, c, i in rows if i > first[k, s, c]]
    assert [(r[0], r[1]) for r in result(size) if r[3]] == sorted(settled)
