import random
import re
import string

from tilewright.llm import line_dedup as m

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
STRIP = " \t\n\r\x0b\x0c"


def expected(texts):
    owner = {}
    for i in sorted(i for i in texts if i is not None):
        for line in (texts[i] or "").split("\n"):
            owner.setdefault(line.strip(STRIP).translate(LOWER), i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(k := x.strip(STRIP).translate(LOWER)) < 10 or i is None or owner[k] == i]
        out[i] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


def found(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, kept string, pos int").repartition(5)
    return {r["id"]: (r["kept"], r["n_lines"], r["n_dropped"]) for r in m.line_dedup(df, **options).collect()}


def made(seed):
    rng = random.Random(seed)
    pool = [f"A common line number {k} é" for k in range(30)] + ["short", "", "   padded line of text \t", "Padded LINE of text", "x" * 9, "ÉÉÉÉÉÉÉÉÉÉ", "éééééééééé"]
    texts = {i: "\n".join(rng.choices(pool, k=rng.randint(0, 12)) + [f"own line of document {i}"] * rng.randint(0, 2)) for i in range(80)}
    return texts | {80: None, 81: "", 82: "\n\n", 83: "\n".join(f"line {k % 200} of a long text" for k in range(3000)), 84: "\n".join(f"line {k} of a long text" for k in range(150, 400))}


def test_equals_brute_force_for_any_batches(spark):
    for batches in (1, 3, 5):
        assert found(spark, made(batches), batches=batches) == expected(made(batches))


def test_runs_are_compacted_by_level(spark):
    store = m.LineStore(spark)
    texts = made(9)
    assert found(spark, texts, batches=5, store=store) == expected(texts)
    assert sum(map(len, store.levels)) <= 3 and len(store.levels) >= 2
    keys = [r for run in store.runs() for r in run.select("h1", "h2").collect()]
    assert len(keys) == len(set(keys))


def test_a_store_is_opened_again_and_who_came_first_owns_a_line(spark, tmp_path):
    folder = str(tmp_path / "store")
    first, second = {10: "a shared line of text\nown line of ten", 11: "a shared line of text"}, {3: "a shared line of text\na new line of text", 12: "a new line of text\nshort", 10: "own line of ten"}
    assert found(spark, first, batches=2, store=m.LineStore(spark, folder=folder)) == expected(first)
    names = set(n for s, n in m._tables)
    for name in names:  # another driver's catalogue knows none of the runs
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    store = m.LineStore(spark, folder=folder)
    assert sum(len(level) for level in store.levels) >= 1 and store.buckets
    assert found(spark, second, batches=2, store=store) == {3: ("a new line of text", 2, 1), 12: ("short", 2, 1), 10: ("", 1, 1)}
    keys = [r for run in m.LineStore(spark, folder=folder).runs() for r in run.select("h1", "h2").collect()]
    assert len(keys) == len(set(keys)) == 3


def test_repeated_ids_are_one_document(spark):
    df = spark.createDataFrame([(1, "a line of some length"), (1, "a line of some length\nx"), (2, "a line of some length"), (1, "a line of some length")], "doc_id long, text string")
    assert sorted((r["id"], r["kept"], r["n_dropped"]) for r in m.line_dedup(df).collect()) == [(1, "a line of some length", 0), (1, "a line of some length", 0), (1, "a line of some length\nx", 0), (2, "", 1)]


def test_batches_grow_with_the_logarithm_of_the_input(spark, monkeypatch):
    df = spark.range(1000)
    assert m.batch_count(df) == m.BATCHES
    monkeypatch.setattr(m, "DOUBLED_BYTES", 1000)
    assert m.BATCHES < m.batch_count(df) <= m.BATCHES + 4
    monkeypatch.setattr(m, "BUCKET_BYTES", 10)
    store = m.LineStore(spark)
    store.size_for(1001)
    assert store.buckets == max(101, int(spark.conf.get("spark.sql.shuffle.partitions")))


def test_null_id_and_empty_table(spark):
    texts = {None: "a line of some length\nx", 1: "a line of some length", 2: "a line of some length\ny"}
    assert found(spark, texts) == expected(texts)
    assert m.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a line of some length")], "doc_id long, text string")
    plan = m.line_dedup(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
