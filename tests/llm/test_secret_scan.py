import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tilewright.llm import secret_scan as m

KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    found = [(a.start(), 0, a.end(), "assign") for a in ASSIGN.finditer(text) if len(a[2]) >= 6]
    found += [(a.start(), 1, a.end(), "access") for a in re.finditer("AKIA[A-Z0-9]+", text) if len(a[0]) >= 20]
    found += [(a.start(), 2, a.end(), "hex") for a in re.finditer("[0-9a-f]+", text) if len(a[0]) >= 24]
    return sorted(found)


def entropy(text):
    found = []
    for c in re.finditer(m.CANDIDATE, text):
        if any(re.search(p, c[0]) for p in m.ALLOWED):
            continue
        for k, (kind, alphabet, least) in enumerate(m.CLASSES):
            hot = []
            for a in range(len(c[0]) - m.WINDOW + 1):
                w = c[0][a : a + m.WINDOW]
                if all(x in alphabet for x in w) and -sum(n / m.WINDOW * math.log2(n / m.WINDOW) for n in Counter(w).values()) >= least - 1e-9:
                    hot.append(a)
            if hot:
                found.append((c.start() + hot[0], 3 + k, c.start() + hot[-1] + m.WINDOW, kind))
    return found


def made():
    rng = random.Random(5)
    hexs, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    pieces = [
        lambda: f'{rng.choice(["password", "PASSWD", "Secret", "token", "api_key", "ApiKey"])}{rng.choice(["", chr(34)])}{rng.choice([":", "=", " = "])}{rng.choice(["", chr(39)])}{"".join(rng.choices(b64, k=rng.randint(1, 12)))}',
        lambda: "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=rng.randint(10, 24))), lambda: "".join(rng.choices(hexs, k=rng.randint(15, 60))), lambda: "".join(rng.choices(b64, k=rng.randint(15, 90))),
        lambda: "secret=token : abcdefgh", lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "some plain words, é😀\n", lambda: "abc" * 20, lambda: "/usr/share/some-long/path_name/file",
    ]
    return {i: rng.choice([" ", "", "\n"]).join(rng.choice(pieces)() for _ in range(rng.randint(0, 14))) for i in range(150)}


def test_equals_brute_force(spark):
    texts = made() | {900: None, 901: "", None: "token=abcdefgh", 902: ("word " * 500 + "token=abcdefgh\n") * 300}
    df = spark.createDataFrame([(i, t, 3) for i, t in texts.items()], "doc_id long, text string, base int")
    for r in m.secret_spans(df).collect():
        t = texts[r["id"]] or ""
        assert [tuple(x) for x in r["base"]] == base(t)
        assert [tuple(x) for x in r["found"]] == sorted(base(t) + entropy(t))
    assert m.secret_spans(df.limit(0)).count() == 0


def test_allow_list(spark):
    df = spark.createDataFrame([(1, "aB3dE5fG7hI9jK1lM3nO5pQ7")], "doc_id long, text string")
    assert m.secret_spans(df).first()["found"] and not m.secret_spans(df, allowed=[*m.ALLOWED, "^aB3"]).first()["found"]
    assert m.secret_spans(df, allowed=[]).first()["found"]


def test_redaction_masks_spans_only(spark):
    texts = made()
    df = spark.createDataFrame([(i, t, "kept", 5) for i, t in texts.items()] + [(None, None, "kept", 5)], "doc_id long, text string, row string, found int")
    rows = m.redact(df).collect()
    assert m.redact(df).columns == df.columns and len(rows) == len(texts) + 1
    for r in rows:
        if r["doc_id"] is None:
            assert r["text"] is None and r["row"] == "kept"
            continue
        t, out, at = texts[r["doc_id"]], "", 0
        runs = []
        for a, _, b, _ in sorted(base(t) + entropy(t)):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        for a, b in runs:
            out, at = out + t[at:a] + "[REDACTED]", b
        assert r["text"] == out + t[at:]


def test_prefix_sums_over_chunks(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: (x % 7).cast("long")).alias("x"))
    got = df.select(m.prefix_sums(F.col("x"))).first()[0]
    assert got == [sum(k % 7 for k in range(1, n)) for n in range(1, 1001)]
    assert df.select(m.prefix_sums(F.array().cast("array<bigint>"))).first()[0] == []


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert not re.search("Python|Pandas|Arrow", m.secret_spans(df)._jdf.queryExecution().executedPlan().toString())


def test_pipeline_masks_random_keys_of_narrow_alphabets(spark):
    import corpus_pipeline

    rng, rows = random.Random(12), []
    alphabets = ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789")
    for alphabet in alphabets:
        for size in (24, 32, 40, 64):
            rows += [(len(rows) + k, "key " + "".join(rng.choices(alphabet, k=size)) + " end", size, alphabet) for k in range(50)]
    rows.append((-1, "plain words and INTERNATIONALIZATIONS 2024-01-02 123e4567-e89b-12d3-a456-426614174000", 0, ""))
    df = spark.createDataFrame([(*r, r[2]) for r in rows], "doc_id long, text string, size long, alphabet string, n_chars long")
    out = corpus_pipeline.redact_secrets(spark, df, None).collect()
    masked = Counter((r["alphabet"], r["size"]) for r in out if "[REDACTED]" in r["text"])
    assert all(masked[a, size] >= 47 for a in alphabets for size in (24, 32, 40, 64)), masked
    assert masked["", 0] == 0


def test_entropy_does_not_drift_over_long_strings(spark):
    rng = random.Random(8)
    bits = [w / 2**m.UNIT for w in m.weights()]
    assert all(abs(b - (c * math.log2(c) if c else 0)) < 1e-11 for c, b in enumerate(bits))
    # the same symbols at the end of a short string and of a very long one: no window reaches the threshold before them
    tail = "".join(rng.choices("0123456789abcdef", k=40))
    texts = {1: "a" * 30 + tail, 2: "ab" * 10_000 + "a" * 30 + tail}
    rows = {r["id"]: r["found"] for r in m.secret_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    ends = {i: [(x["start"] - len(t), x["stop"] - len(t), x["kind"]) for x in rows[i] if x["kind"].startswith("entropy")] for i, t in texts.items()}
    assert ends[1] == ends[2] and ends[1]
    assert [tuple(x) for x in rows[2]] == sorted(base(texts[2]) + entropy(texts[2]))
