import hashlib
import random
import string
from collections import defaultdict

from tilewright.llm import exact_dedup as m

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def expected(rows, pick):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = pick(real) if real else None
        out += [(i, keep, len(ids), keep is None or i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def found(spark, rows, keep):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, keep_id string, hash int").repartition(7)
    return sorted((tuple(r) for r in m.content_sort_dedup(df, keep=keep).collect()), key=str)


def test_groups_of_any_size(spark):
    rng = random.Random(4)
    hot = "One very common TEXT " * 30
    rows = [(i, rng.choice([hot, hot.lower(), f"text {rng.randint(0, 40)} É", f"Text {rng.randint(0, 40)} é", "", None])) for i in range(900)]
    for keep, pick in (("largest", max), ("smallest", min)):
        assert found(spark, rows, keep) == expected(rows, pick)


def test_equal_prefixes_differ_in_full(spark):
    rows = [(i, "p" * 500 + str(i % 3) + "q" * 500) for i in range(60)]
    assert found(spark, rows, "smallest") == expected(rows, min)


def test_null_ids_repeated_rows_long_and_empty(spark):
    rows = [(None, "a"), (5, "A"), (5, "a"), (None, "alone"), (7, "x" * 300_000), (8, "X" * 300_000), (9, "")]
    got = [r[:4] for r in found(spark, rows, "largest")]
    assert sorted(got, key=str) == sorted([(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (None, None, 1, True), (7, 8, 2, False), (8, 8, 2, True), (9, 9, 1, True)], key=str)
    assert m.content_sort_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_over_blocks_and_partitions_by_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 5)
    monkeypatch.setattr(m, "PART_ROWS", 40)  # more partitions than the session's
    rng = random.Random(6)
    rows = [(rng.choice([None, i]), rng.choice(["", "same text", "Same Text", f"t{i % 9}"])) for i in range(600)]
    for keep, pick in (("largest", max), ("smallest", min)):
        got = found(spark, rows, keep)
        assert sorted(r[:3] + r[4:] for r in map(tuple, got) if r[0] is not None) == sorted(r[:3] + r[4:] for r in expected(rows, pick) if r[0] is not None)
        assert len(got) == len(rows) and sum(r[0] is None for r in got) == sum(i is None for i, _ in rows)


def test_first_of_each_keeps_whole_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "PART_ROWS", 25)  # groups over many partitions
    rng = random.Random(9)
    hot = "A common TEXT " * 40
    rows = [(rng.choice([None, i % 170, i]), rng.choice([hot, hot.lower(), "", None, f"t{rng.randint(0, 60)}", f"T{i}"]), f"r{i}", {"norm": i}) for i in range(500)]
    rows += [(None, "nameless", "b", {"norm": 1}), (None, "Nameless", "a", {"norm": 2}), (3, "x" * 200_000, "long", {"norm": 3})]
    df = spark.createDataFrame([(*r[:3], r[3]["norm"]) for r in rows], "doc_id long, text string, border string, part int").repartition(5)
    got = [tuple(r) for r in m.first_of_each(df).collect()]
    groups = defaultdict(list)
    for i, t, a, b in rows:
        groups[(t or "").translate(LOWER)].append((i, t, a, b["norm"]))
    assert m.first_of_each(df).columns == df.columns and len(got) == len(groups)
    for r in got:
        own = groups[(r[1] or "").translate(LOWER)]
        ids = [o[0] for o in own if o[0] is not None]
        best = [o for o in own if o[0] == (min(ids) if ids else None)]
        # nulls first, as columns sort
        assert r == min(best, key=lambda o: (o[1] is not None, (o[1] or "").encode(), o[2], o[3]))
    assert m.first_of_each(df.limit(0)).count() == 0
