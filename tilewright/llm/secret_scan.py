"""Secret scans with DataFrame functions only.

Fixed patterns give the base spans. Beyond them, every candidate string is scanned with a sliding window for each
character class: the window's symbol counts, and the sum of c*log2(c) over them, change by the one symbol that enters and
the one that leaves, and the Shannon entropy is log2(window) - sum / window. The sum is in whole units of 2^-UNIT bits, so that
it is the same however long the string before the window is. Windows at or over the class' threshold make
a span, unless an allow-list pattern fits the candidate. Everything is local to a row: no exchange.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents

# The patterns of the base kinds, and what their matches need (characters of the group, of the match).
ASSIGN_KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = ASSIGN_KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:passw|secret|token|api_?key)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST = 6
BASE_KINDS = ("assign", "access", "hex")

#: Candidate strings, the window in characters, and each class: name, alphabet, least entropy in bits.
CANDIDATE, WINDOW = "[A-Za-z0-9+/_=-]{20,}", 20
#: Binary digits after the point of c*log2(c).
UNIT = 40
CLASSES = (
    ("entropy_hex", "0123456789abcdef", 3.0),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.9),
)
#: Further classes that redaction scans: alphabets whose random strings seldom reach 3.9 bits. Each threshold is near the 1% point of one
#: random window's entropy (2.88 bits for 16 symbols, 3.40 for 36). ``op9_secret_scan`` has the classes of its SQL alone.
NARROW_CLASSES = (
    ("entropy_upper_hex", "0123456789ABCDEF", 2.88),
    ("entropy_upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.4),
    ("entropy_lower", "abcdefghijklmnopqrstuvwxyz0123456789", 3.4),
)
#: Candidates that are no secrets: words, numbers and rules, UUIDs, and strings that call themselves examples.
ALLOWED = ("^[A-Za-z_/=+-]+$", "^[0-9_/=+-]+$", "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", "(?i:example|sample|placeholder|dummy|xxxx)")
#: Elements that prefix sums take at a time; appending to an array copies it.
CHUNK = 256
_SPANS = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


def prefix_sums(x: Column) -> Column:
    """What stands before each element of an array of longs, summed."""

    def inner(chunk):
        return F.aggregate(
            chunk, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")),
            lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["out"], a["at"]).alias("out")),
        )

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda b: inner(F.slice(x, b * CHUNK + 1, CHUNK)))
    whole = F.aggregate(
        chunks, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("out")),
        lambda a, c: F.struct((a["at"] + c["at"]).alias("at"), F.array_append(a["out"], F.transform(c["out"], lambda v: v + a["at"])).alias("out")),
    )
    return F.when(F.size(x) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(whole["out"]))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _steps(matches: Column, gaps: Column) -> Column:
    return F.zip_with(gaps, matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))


def weights() -> list[int]:
    """c*log2(c) of every count that a window can reach while a symbol enters before another leaves."""
    return [round(c * math.log2(c) * 2**UNIT) if c else 0 for c in range(WINDOW + 2)]


def _entropy(candidate: Column, alphabet: str, least: float) -> Column:
    """``first, last``: where in the candidate the first window at or over ``least`` starts and the last one stops; -1 for none."""
    weight = F.array(*[F.lit(w) for w in weights()])
    most = math.floor((math.log2(WINDOW) - least) * WINDOW * 2**UNIT)  # a window of at most this sum has the entropy
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c))
    zero = F.array_repeat(F.lit(0), len(alphabet))
    nothing = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), nothing.alias("sum"), F.lit(0).alias("run"), F.lit(0).alias("i"), _none("array<int>").alias("codes"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def change(n, code, by):
        return F.transform(n, lambda v, j: F.when(j == code - 1, v + by).otherwise(v))

    def step(a, code):
        # in ``codes`` stands the window: the symbols that are to leave, oldest first
        full = a["run"] >= WINDOW
        oldest = F.get(a["codes"], F.lit(0))
        left = F.when(full, change(a["n"], oldest, -1)).otherwise(a["n"])
        had = F.get(a["n"], oldest - 1)
        less = F.when(full, F.get(weight, had) - F.get(weight, had - 1)).otherwise(nothing)
        same = F.when(full & (oldest == code), 1).otherwise(0)
        has = F.get(a["n"], code - 1) - same
        total = a["sum"] - less + F.get(weight, has + 1) - F.get(weight, has)
        run = F.when(full, F.lit(WINDOW)).otherwise(a["run"] + 1)
        hot = (run == WINDOW) & (total <= most)
        inside = F.struct(
            change(left, code, 1).alias("n"), total.alias("sum"), run.alias("run"), (a["i"] + 1).alias("i"),
            F.array_append(F.when(full, F.slice(a["codes"], 2, WINDOW)).otherwise(a["codes"]), code).alias("codes"),
            F.when(hot & (a["first"] < 0), a["i"] + 1 - WINDOW).otherwise(a["first"]).alias("first"), F.when(hot, a["i"] + 1).otherwise(a["last"]).alias("last"),
        )
        outside = F.struct(zero.alias("n"), nothing.alias("sum"), F.lit(0).alias("run"), (a["i"] + 1).alias("i"), _none("array<int>").alias("codes"), a["first"].alias("first"), a["last"].alias("last"))
        return F.when(code > 0, inside).otherwise(outside)

    return F.aggregate(codes, start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _spanned(rows: DataFrame, allowed: Sequence[str], classes: Sequence[tuple[str, str, float]] = CLASSES) -> DataFrame:
    """``row, text`` with ``base`` and ``found`` added."""
    kinds = (("assign", ASSIGN, F.col("text").rlike(ASSIGN_HINT)), ("access", ACCESS, F.col("text").contains("AKIA")), ("hex", HEX, F.col("text").rlike(HEX)), ("word", CANDIDATE, F.col("text").rlike(CANDIDATE)))
    strings = "array<string>"
    hits = rows.select(
        "row",
        "text",
        *(c for name, pattern, hint in kinds for c in (
            F.when(hint, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(_none(strings)).alias(f"{name}_m"),
            F.when(hint, F.split("text", pattern, -1)).otherwise(_none(strings)).alias(f"{name}_g"))),
        F.when(kinds[0][2], F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))).otherwise(_none(strings)).alias("assign_v"),
    )
    at = hits.select(
        "*",
        *(prefix_sums(_steps(F.col(f"{name}_m"), F.slice(f"{name}_g", F.lit(1), F.size(f"{name}_m")))).alias(f"{name}_s") for name, *_ in kinds),
    )
    span = lambda start, rank, stop, kind: F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), stop.cast("long").alias("stop"), F.lit(kind).alias("kind"))

    def starts(name):
        return F.zip_with(f"{name}_s", F.slice(f"{name}_g", F.lit(1), F.size(f"{name}_m")), lambda s, g: s + F.length(g))

    at = at.select("*", *(starts(name).alias(f"{name}_a") for name, *_ in kinds))

    def base(rank, name):
        whole = F.zip_with(f"{name}_a", f"{name}_m", lambda s, m: span(s, rank, s + F.length(m), name))
        if name == "assign":
            whole = F.filter(F.zip_with(whole, "assign_v", lambda w, v: F.when(F.length(v) >= ASSIGN_LEAST, w)), lambda w: w.isNotNull())
        return F.when(F.size(f"{name}_m") == 0, _none(_SPANS)).otherwise(whole)

    def scanned(rank, kind, alphabet, least):
        suspect = F.filter(F.arrays_zip(F.col("word_m").alias("m"), F.col("word_a").alias("a")), lambda w: ~functools.reduce(operator.or_, [w["m"].rlike(p) for p in allowed], F.lit(False)))
        hot = F.transform(suspect, lambda w: F.struct(w["a"].alias("a"), _entropy(w["m"], alphabet, least).alias("e")))
        spans = F.transform(F.filter(hot, lambda h: h["e"]["first"] >= 0), lambda h: span(h["a"] + h["e"]["first"], rank, h["a"] + h["e"]["last"], kind))
        return F.when(F.size("word_m") == 0, _none(_SPANS)).otherwise(spans)

    both = at.select(
        "row",
        "text",
        F.array_sort(F.concat(*(base(k, name) for k, name in enumerate(BASE_KINDS)))).alias("base"),
        F.concat(*(scanned(len(BASE_KINDS) + k, *c) for k, c in enumerate(classes))).alias("more"),
    )
    return both.select("row", "text", "base", F.array_sort(F.concat("base", "more")).alias("found"))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``id, base, found``: arrays of ``(start, rank, stop, kind)`` in code points, stop exclusive, sorted by start and kind. ``base``
    holds the pattern kinds alone, ``found`` these and the entropy kinds.

    Null and empty texts have no spans; a null id stays; repeated rows repeat; an empty table gives an empty result; other
    columns are not read. Texts of any length are scanned whole."""
    rows = df.select(F.col(id_col).cast("long").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _spanned(rows, allowed).select(F.col("row").alias("id"), "base", "found")


def span_text(spans) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(df: DataFrame, text_col: str = "text", mask: str = "[REDACTED]", allowed: Sequence[str] = ALLOWED, classes: Sequence[tuple[str, str, float]] = CLASSES) -> DataFrame:
    """``df`` with every span of its text that the patterns or ``classes`` find replaced by ``mask``; spans that overlap or touch share one. Null texts stay
    null; other columns, whatever their names, pass through; rows neither come nor go."""
    rows = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    start = F.struct(F.lit(0).cast("long").alias("at"), _none("array<string>").alias("out"))

    def step(a, s):
        gap = F.substring(F.col("text"), a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int"))
        apart = (s["start"] > a["at"]) | (F.size(a["out"]) == 0)
        out = F.when(apart, F.array_append(a["out"], F.concat(gap, F.lit(mask)))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), out.alias("out"))

    clean = F.aggregate("found", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"].cast("int") + 1, F.length("text"))))
    changed = F.when(F.size("found") > 0, clean).otherwise(F.col("row")[text_col])
    return _spanned(rows, allowed, classes).select(F.col("row").withField(text_col, changed).alias("row")).select("row.*")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secret_spans(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return s.select(F.col("id").alias("doc_id"), *(count(k) for k in BASE_KINDS), F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("found").alias("spans"))


def _oracle() -> str:
    """The patterns as in the operator; letters of keywords spelled out in both cases; windows counted afresh."""
    both = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = [(0, "assign", ASSIGN.replace(ASSIGN_KEYWORDS, f"(?:{both})")), (1, "access", ACCESS), (2, "hex", HEX), (9, "word", CANDIDATE)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, {rank} AS rank, '{name}' AS kind, unnest(string_split_regex(t, {quote(p)})) AS gap, unnest(regexp_extract_all(t, {quote(p)})) AS hit, "
        f"unnest(regexp_extract_all(t, {quote(p)}, {1 if rank == 0 else 0})) AS part, unnest(range(0, len(t) + 1)[1:len(regexp_extract_all(t, {quote(p)})) + 1]) AS k FROM t"
        for rank, name, p in kinds
    )
    classes = " UNION ALL ".join(
        f"SELECT doc_id, {len(BASE_KINDS) + k} AS rank, '{name}' AS kind, min(pos) AS start, max(pos) + {WINDOW} AS stop FROM h WHERE regexp_full_match(win, '[{alphabet.replace("-", "")}{"-" * ("-" in alphabet)}]+') AND e >= {least} GROUP BY doc_id, first"
        for k, (name, alphabet, least) in enumerate(CLASSES)
    )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
s AS (SELECT doc_id, rank, kind, hit, part, sum(len(gap)) OVER w + coalesce(sum(len(hit)) OVER v, 0) AS start FROM m WHERE k IS NOT NULL
  WINDOW w AS (PARTITION BY doc_id, rank ORDER BY k), v AS (PARTITION BY doc_id, rank ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
base AS (SELECT doc_id, rank, kind, CAST(start AS BIGINT) AS start, CAST(start + len(hit) AS BIGINT) AS stop FROM s WHERE hit IS NOT NULL AND rank < 9 AND (rank > 0 OR len(part) >= {ASSIGN_LEAST})),
c AS (SELECT doc_id, start AS first, hit, unnest(range(0, len(hit) - {WINDOW} + 1)) AS w FROM s WHERE rank = 9 AND hit IS NOT NULL AND NOT ({" OR ".join(f"regexp_matches(hit, {quote(p)})" for p in ALLOWED)})),
x AS (SELECT doc_id, first, w, substr(hit, CAST(w AS BIGINT) + 1, {WINDOW}) AS win, unnest(string_split(substr(hit, CAST(w AS BIGINT) + 1, {WINDOW}), '')) AS ch FROM c),
n AS (SELECT doc_id, first, w, win, ch, count(*) AS n FROM x GROUP BY ALL),
h AS (SELECT doc_id, first, CAST(first + w AS BIGINT) AS pos, win, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS e FROM n GROUP BY ALL),
more AS ({classes}),
b AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM t LEFT JOIN b ON b.doc_id = t.doc_id LEFT JOIN a ON a.doc_id = t.doc_id
"""


ORACLE = _oracle()
