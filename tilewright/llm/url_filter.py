"""URL filters: allow and block rules, and gradient-boosted trees on lexical features for what no rule judges.

The trees learn from URLs that the rules label. They are fitted on the driver from at most ``SAMPLE`` different labelled URLs
(those of the least hashes); the model has a fixed size. A training row's suffix statistics come from the other ``FOLDS - 1`` folds, so that
its own label is not among its features. Rules and parsing are column expressions, features and trees run over Arrow batches; only
the sample is exchanged.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, small_batches

#: Different labelled URLs that the trees are fitted on, at most; parts of them that take their suffix statistics from the rest.
SAMPLE, FOLDS = 20_000, 5
#: Boosting: trees, depth, learning rate, histogram bins, and the prior rows that smooth statistics and leaves.
TREES, DEPTH, RATE, BINS, PRIOR = 40, 3, 0.2, 32, 5.0
FEATURES = (
    "length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens",
    "longest_segment", "vowel_ratio", "has_fragment", "is_https",
    "suffix_rate", "suffix_rows", "domain_rate", "domain_rows", "section_rate", "section_rows",
)

#: Features without statistics, which come first; characters of a suffix key that is kept as it is.
PLAIN, KEY_MOST = 13, 128

# The rules of the registered query, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass
class Model:
    suffixes: dict[str, tuple[float, float]]
    base: float
    edges: np.ndarray  #: (features, BINS - 1)
    feature: np.ndarray  #: (trees, 2^DEPTH - 1), breadth first
    bin: np.ndarray  #: a value of at most this bin goes left
    leaf: np.ndarray  #: (trees, 2^DEPTH)


def url_host(url) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as text; null where none does. A rule fits its host and all subdomains."""
    longest_first = sorted((rule for _, rule in rules), key=lambda r: (-len(r), r))
    if not longest_first:
        return F.lit(None).cast("string")
    parts = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit("." + r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for r in longest_first])
    fitting = F.filter(parts, lambda r: F.endswith(F.concat(F.lit("."), host), r["host"]) & F.startswith(path, r["path"]))
    return F.get(fitting, F.lit(0))["rule"]


def verdict_of(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    if not rules:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for verdict, text in rules for x in (text, verdict)])[rule]


def plain(urls: Sequence[str | None], hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    """(urls, PLAIN): the features that need no statistics."""
    out = np.zeros((len(urls), PLAIN))
    for k, (url, host, path) in enumerate(zip(urls, hosts, paths, strict=True)):
        url = url or ""
        n = max(1, len(url))
        query = url.partition("#")[0].partition("?")[2]
        out[k] = (
            len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / n,
            -sum(c / n * math.log2(c / n) for c in Counter(url).values()), (query.count("&") + 1) if query else 0, host.count(".") + bool(host),
            url.count("-"), max(map(len, path.split("/"))), sum(url.count(v) for v in "aeiou") / n, "#" in url, url.startswith("https:"),
        )
    return out


def with_statistics(x: np.ndarray, keys: Sequence[Sequence[str]], suffixes: dict[str, tuple[float, float]]) -> np.ndarray:
    """(rows, FEATURES) from (rows, PLAIN) and each row's suffix keys."""
    known = [[v for key in own for rate, rows in (suffixes.get(key, suffixes[""]),) for v in (rate, math.log1p(rows))] for own in keys]
    return np.hstack([x, np.array(known, np.float64).reshape(len(x), len(FEATURES) - PLAIN)])


def lexical(urls: Sequence[str | None], hosts: Sequence[str], paths: Sequence[str], suffixes: dict[str, tuple[float, float]]) -> np.ndarray:
    """(urls, FEATURES)."""
    return with_statistics(plain(urls, hosts, paths), list(map(suffix_keys, hosts, paths)), suffixes)


def suffix_keys(host: str, path: str) -> tuple[str, str, str]:
    """What statistics are kept of: the last label, the last two, and the last label with the path's first segment. Keys of more than
    ``KEY_MOST`` characters are told apart by their SHA-256, so that the sample and the model have a bound in bytes."""
    labels = host.split(".")
    keys = labels[-1] + "/", ".".join(labels[-2:]), f"{labels[-1]}/{path.split('/')[1] if '/' in path else ''}/"
    return tuple(k if len(k) <= KEY_MOST else hashlib.sha256(k.encode("utf-8", "replace")).hexdigest() for k in keys)


def suffix_statistics(hosts: Sequence[str], paths: Sequence[str], blocked: np.ndarray) -> dict[str, tuple[float, float]]:
    return _statistics(list(map(suffix_keys, hosts, paths)), blocked)


def _statistics(keys: Sequence[Sequence[str]], blocked: np.ndarray) -> dict[str, tuple[float, float]]:
    """Of each suffix: its smoothed rate of blocked rows and its rows; "" for what was not seen."""
    mean = float(blocked.mean()) if len(blocked) else 0.5
    rows, hits = Counter(), Counter()
    for own, b in zip(keys, blocked, strict=True):
        for key in own:
            rows[key] += 1
            hits[key] += float(b)
    return {"": (mean, 0.0)} | {s: ((hits[s] + PRIOR * mean) / (rows[s] + PRIOR), float(rows[s])) for s in rows}


def out_of_fold(urls: Sequence[str], hosts: Sequence[str], paths: Sequence[str], blocked: np.ndarray) -> np.ndarray:
    """(urls, FEATURES) for training: each row's statistics are of the rows of other folds. Rows of one host share a fold, dealt by the host's
    CRC-32, so that a host's statistics do not come from its own rows either."""
    return _out_of_fold(plain(urls, hosts, paths), list(map(suffix_keys, hosts, paths)), np.array([fold_of(h) for h in hosts], np.int64), blocked)


def fold_of(host: str | None) -> int:
    return zlib.crc32((host or "").encode("utf-8", "replace")) % FOLDS


def _out_of_fold(x: np.ndarray, keys: Sequence[Sequence[str]], fold: np.ndarray, blocked: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(FEATURES)))
    for k in range(FOLDS):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(own):
            out[own] = with_statistics(x[own], [keys[i] for i in own], _statistics([keys[i] for i in rest], blocked[rest]))
    return out


def _sampled(batches):
    """What the fit needs of each URL of the sample, of bounded size whatever the URL's."""
    for b in batches:
        urls, hosts, paths = (b.column(c).to_pylist() for c in range(3))
        x, keys = plain(urls, hosts, paths), list(map(suffix_keys, hosts, paths))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), pa.list_(pa.float64())), pa.array(map(list, keys), pa.list_(pa.string())), pa.array([fold_of(h) for h in hosts], pa.int32()), b.column(3)], ["x", "keys", "fold", "y"])


def boost(x: np.ndarray, y: np.ndarray, suffixes: dict[str, tuple[float, float]]) -> Model:
    """Trees of logistic loss over quantile bins; each split is the best gain of second order over all features and bins."""
    n_nodes = (1 << DEPTH) - 1
    feature, split, leaf = np.zeros((TREES, n_nodes), np.int64), np.full((TREES, n_nodes), BINS, np.int64), np.zeros((TREES, 1 << DEPTH))
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T if len(x) else np.zeros((len(FEATURES), BINS - 1))
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Model(suffixes, math.log(mean / (1 - mean)), edges, feature, split, leaf)
    if not len(x):
        return model
    binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(x.shape[1])], axis=1)
    raw = np.full(len(x), model.base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = y - p, p * (1 - p), np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-9)
            for f in range(x.shape[1]):
                at = (node - first) * BINS + binned[:, f]
                gs = np.bincount(at, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(at, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                b = gain.argmax(axis=1)
                better = gain[np.arange(width), b] > best
                best = np.where(better, gain[np.arange(width), b], best)
                feature[t, first : first + width][better] = f
                split[t, first : first + width][better] = b[better]
            node = 2 * node + 1 + (binned[np.arange(len(x)), feature[t, node]] > split[t, node])
        end = node - n_nodes
        leaf[t] = RATE * np.bincount(end, g, 1 << DEPTH) / (np.bincount(end, h, 1 << DEPTH) + 1)
        raw += leaf[t, end]
    return model


def block_probability(model: Model, x: np.ndarray) -> np.ndarray:
    binned = np.stack([np.searchsorted(model.edges[f], x[:, f]) for f in range(x.shape[1])], axis=1)
    raw, rows = np.full(len(x), model.base), np.arange(len(x))
    for t in range(TREES):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[rows, model.feature[t, node]] > model.bin[t, node])
        raw += model.leaf[t, node - model.feature.shape[1]]
    return 1 / (1 + np.exp(-raw))


def _scores(shared):
    def scan(batches):
        model = Model(*shared.value)
        for b in batches:
            x = lexical(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), model.suffixes)
            yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:], pa.array(block_probability(model, x) if len(x) else np.zeros(0))], ["id", "host", "path", "rule", "score"])

    return scan


def judged(df: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``id, url, host, path, rule`` by column expressions."""
    parsed = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    return parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def fit(labelled: DataFrame) -> Model:
    """``labelled``: url, host, path, verdict; rows without a verdict do not count. The features, suffix keys and folds of a bounded sample of its
    different URLs go to the driver, not the URLs, whose length has no bound; a URL with both verdicts counts as blocked."""
    small_batches(labelled.sparkSession)
    labelled = labelled.filter(F.col("verdict").isNotNull()).select("url", *(F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")), "verdict")
    n = labelled.agg(F.approx_count_distinct("url")).first()[0]
    at = F.xxhash64("url", F.lit("sample"))
    # twice the share that would do, so that the limit decides; a URL of many rows is one row of the sample
    part = labelled.filter(F.pmod(at, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * SAMPLE / max(n, 1))))
    part = part.groupBy("url", "host", "path").agg(F.max((F.col("verdict") == "block").cast("double")).alias("y"))
    # the key of the SAMPLE-th URL in the order of (hash, SHA-256); the URLs up to it are the sample
    order = [at.alias("at"), F.sha2(F.coalesce("url", F.lit("")), 256).alias("sha")]
    last = part.select(*order).orderBy("at", "sha").limit(SAMPLE).agg(F.max(F.struct("at", "sha")).alias("last")).first()["last"]
    if last is None:
        return boost(np.zeros((0, len(FEATURES))), np.zeros(0), _statistics([], np.zeros(0)))
    least = part.select("url", "host", "path", "y", *order).filter((F.col("at") < last["at"]) | (F.col("at") == last["at"]) & (F.col("sha") <= last["sha"]))
    found = least.select("url", "host", "path", "y").mapInArrow(_sampled, "x array<double>, keys array<string>, fold int, y double").collect()
    # in an order of their own, so that the sums do not depend on who came first
    found.sort(key=lambda r: (r["keys"], r["x"], r["y"]))
    x, keys, y = np.array([r["x"] for r in found], np.float64).reshape(-1, PLAIN), [r["keys"] for r in found], np.array([r["y"] for r in found])
    return boost(_out_of_fold(x, keys, np.array([r["fold"] for r in found], np.int64), y), y, _statistics(keys, y))


def url_filter(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """``id, host, path, rule, verdict, score`` for each row; ``score`` is the trees' probability of block, and the verdict where no
    rule fits.

    ``labelled`` (url, host, path, verdict) defaults to the rows that rules judge; without any, the score is 0.5 and such rows
    are allowed. Null urls and those without ``://`` have empty host and path, which no rule fits. ``rules`` is a list of at most some
    hundreds, a column expression each. Repeated rows repeat, null ids stay, an empty table gives an empty result."""
    spark = df.sparkSession
    small_batches(spark)
    rows = judged(df, id_col, url_col, rules)
    if labelled is None:
        labelled = rows.withColumn("verdict", verdict_of(F.col("rule"), rules)).filter(F.col("verdict").isNotNull())
    shared = spark.sparkContext.broadcast(astuple(fit(labelled)))  # TREES trees and the suffixes of at most SAMPLE rows
    scored = rows.mapInArrow(_scores(shared), "id long, host string, path string, rule string, score double")
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
