import random
import re
import time

import numpy as np
import pytest
import xxhash

from tilewright.llm import simhash as m


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, radius=3):
    """Smallest id reachable, by all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def clustered(seed, n=250):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(12)]
    out = {}
    for i in range(n):
        v = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            v ^= 1 << rng.randrange(64)
        out[i * 7] = v
    return out


def linked(spark, prints, **options):
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()], "id long, fp long").repartition(4)
    components = {r["fp"] % (1 << 64): r["component"] for r in m.link(df, **options).collect()}
    return {i: components[v] for i, v in prints.items()}


@pytest.mark.parametrize("group", [m.GROUP, 8])
def test_components_equal_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(m, "GROUP", group)  # the second cuts keys into pairs of blocks
    prints = clustered(group % 5)
    assert linked(spark, prints) == roots(prints)


@pytest.mark.parametrize("direct", [4, 60])
def test_keys_dealt_again_give_the_same_sets(direct):
    prints = clustered(3, 400)
    fps, ids = np.array(list(prints.values()), np.uint64), np.array(list(prints))
    sets = lambda found: sorted((root, sorted(others.tolist())) for root, others in found)
    assert sets(m.forest(fps, ids, direct=direct)) == sets(m.forest(fps, ids, direct=10**9))


def test_many_unlinked_members_of_one_key():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 43, 200_000, np.uint64) << np.uint64(21)  # 21 bits of the key are equal
    fps[1] = fps[150_000] ^ np.uint64(7 << 30)
    began = time.perf_counter()
    found = {root: set(others.tolist()) for root, others in m.forest(fps, np.arange(len(fps)))}
    assert time.perf_counter() - began < 60
    assert 150_000 in found[1]


@pytest.mark.parametrize("changes", [{"HUB": 3, "HUB_WAYS": 4}])
def test_hubs_are_cut(spark, monkeypatch, changes):
    for name, value in changes.items():
        monkeypatch.setattr(m, name, value)
    prints = clustered(2) | {k: 0 for k in range(10_000, 10_040)} | {20_000 + b: 1 << b for b in range(64)}
    assert linked(spark, prints) == roots(prints)
    texts = [(i, t) for i, t in enumerate(["", "one two three four", None, " ", "five six seven"] * 8)]
    got = {r["id"]: r["component"] for r in m.simhash_groups(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == roots({i: print_of(t) for i, t in texts})


def test_long_chains(spark):
    prints, v = {}, 0
    for k in range(40):  # each is linked only to its neighbours
        v ^= 0b111 << (3 * k) % 61
        prints[100 - k] = v
    assert linked(spark, prints) == roots(prints)


@pytest.mark.parametrize("thresholds", [(2, 0), (0, 2), (1, 1), (1, 0, 0), (0, 0, 1), (0, 0, 0, 0), (2, -1, 0), (1, 1, -1)])
def test_any_allocation_finds_every_link(spark, monkeypatch, thresholds):
    prints = clustered(7, 150)
    groups = m.correlated_parts(np.eye(64), 10, len(thresholds))
    monkeypatch.setattr(m, "plan", lambda *a: list(zip(groups, thresholds, strict=True)))
    assert linked(spark, prints) == roots(prints)


def test_plan_sums_to_the_pigeonhole_bound():
    rng = np.random.default_rng(2)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    bits = m._bits(sample).astype(float)
    for n in (10, 10**5, 10**9):
        scheme = m.plan(bits.T @ bits * n / 500, n, sample)
        assert sum(t for _, t in scheme) == m.RADIUS - len(scheme) + 1
        assert sorted(b for g, _ in scheme for b in g) == list(range(64))
    together = np.full((64, 64), 25.0)  # independent bits
    np.fill_diagonal(together, 50)
    together[3, 40] = together[40, 3] = 50  # two bits that are always equal
    assert any({3, 40} <= set(g) for g in m.correlated_parts(together, 100, 4))


def test_fingerprints_and_odd_rows(spark):
    texts = {1: None, 2: "", 3: " \n\t ", 4: "One two", 5: "ONE TWO", 6: "a b c", 7: "a b c d e f " * 20_000, 8: "x\x0by\x0cz É\xa0é ſ", 9: "same text of five words", 10: "Same text of five words"}
    df = spark.createDataFrame([(i, t, "c") for i, t in texts.items()] + [(None, "one two", "c"), (None, "nobody else has this", "c")], "doc_id long, text string, fp string")
    rows = m.simhash_groups(df).collect()
    for r in rows:
        if r["id"] is not None:
            assert r["fp"] % (1 << 64) == print_of(texts[r["id"]])
    by = {r["id"]: r["component"] for r in rows if r["id"] is not None}
    assert by == roots({i: print_of(t) for i, t in texts.items()})
    assert sorted(str(r["component"]) for r in rows if r["id"] is None) == ["4", "None"]
    assert m.simhash_groups(df.limit(0)).count() == 0


def test_registered_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: print_of(t) for i, t in texts.items()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in m.op10_simhash(spark, sf).collect()}
    component = roots(prints)
    assert got == {i: (f"{prints[i]:016x}", component[i]) for i in texts}
