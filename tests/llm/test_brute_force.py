"""Registered queries that SQL cannot express, against versions in plain Python that share no code with the operators."""

import cmath
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tilewright.llm import language_id, media, packing, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


# Packing: ids of the vocabulary file, and sequential packing along the curve


def curve(x, bits):
    """Place of a cell on the Hilbert curve, bit by bit (Skilling 2004)."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def point(text):
    counts = [0] * packing.BUCKETS
    padded = text + bytes(3)
    for k in range(len(text)):
        counts[(int.from_bytes(padded[k : k + 4], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 22] += 1
    matrix = np.random.default_rng(7).standard_normal((packing.BUCKETS, packing.DIMS))
    return [sum(math.sqrt(c) * matrix[b, d] for b, c in enumerate(counts) if c) / max(1.0, math.sqrt(len(text))) for d in range(packing.DIMS)]


def test_packing(spark, texts):
    tokenizer = Tokenizer.from_file(packing.default_vocabulary_folder() + "/byte_bpe_50k.json")
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    rows = packing.op1_packing(spark, SF).collect()
    sequences = {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(own), r["doc_tokens"]) == (r["length"], len(ids[r["doc_id"]]))
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"], r["start"]))
    along = []
    for number in sorted(sequences):
        pieces, at = sorted(sequences[number]), 0
        for offset, length, doc, start in pieces:
            assert offset == at
            at += length
            along.append((doc, start))
        assert at == 1024 or at & (at - 1) == 0
    # each document's pieces follow one another, and documents follow the curve
    order = list(dict.fromkeys(doc for doc, _ in along))
    assert len(order) == len(texts) and along == [(d, s) for d in order for s in sorted(s for e, s in along if e == d)]
    points = {i: point(t.encode()) for i, t in texts.items()}
    every = np.array(list(points.values()))
    mean, deviation = every.mean(axis=0), every.std(axis=0)
    cells = {i: [min(1023, int(1024 / (1 + math.exp(-1.702 * (p[d] - mean[d]) / deviation[d])))) for d in range(packing.DIMS)] for i, p in points.items()}
    keys = {i: curve(c, packing.BITS) for i, c in cells.items()}
    steps = [(keys[a], a) <= (keys[b], b) for a, b in zip(order, order[1:])]
    assert sum(steps) >= len(steps) - 2  # a cell's border may lie within rounding


# Language ID: the same grams in sets, without filters


def grams_of(text):
    folded = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower())
    raw = b" " + folded.encode() + b"   "
    return [raw[k : k + 4] for k in range(len(raw) - 3)]


def test_language_id(spark, texts):
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    counts = {}
    for i, t in texts.items():
        if not held[i] and labels[i] is not None and any(c.isalpha() for c in t):
            own = counts.setdefault(labels[i], {})
            for g in grams_of(t):
                own[g] = own.get(g, 0) + 1
    number = lambda g: int.from_bytes(g, "little")
    known = {lang: {g for g, _ in sorted(c.items(), key=lambda x: (-x[1], number(x[0])))[: language_id.GRAMS]} for lang, c in counts.items()}
    same = 0
    rows = language_id.op5_language_id(spark, SF).collect()
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]]
        if not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own = grams_of(t)
        share = {lang: sum(g in k for g in own) / len(own) for lang, k in known.items()}
        best = max(share.values())
        assert share[r["lang_pred"]] >= best - 0.01 and abs(r["gram_share"] - best) < 0.02
        assert abs(r["score"] - share[r["lang_pred"]] / sum(share.values())) < 0.02
        same += 1
    assert same > 150


# URL filters: features counted letter by letter, and trees walked one row at a time


def features(url, host, path, rates):
    counts = {c: url.count(c) for c in set(url)}
    n = max(1, len(url))
    query = url.split("#")[0].split("?", 1)[1] if "?" in url.split("#")[0] else ""
    labels = host.split(".")
    keys = (labels[-1] + "/", ".".join(labels[-2:]), labels[-1] + "/" + (path.split("/")[1] if "/" in path else "") + "/")
    out = [len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / n, -sum(k / n * math.log2(k / n) for k in counts.values()), len(query.split("&")) if query else 0,
           len(labels) if host else 0, url.count("-"), max(len(s) for s in path.split("/")), sum(c in "aeiou" for c in url) / n, float("#" in url), float(url[:6] == "https:")]
    for k in keys:
        rate, rows = rates.get(k, rates[""])
        out += [rate, math.log1p(rows)]
    return out


def walked(model, x):
    raw = model.base
    for t in range(len(model.leaf)):
        node = 0
        while node < model.feature.shape[1]:
            f = model.feature[t, node]
            bin_ = sum(e < x[f] for e in model.edges[f])
            node = 2 * node + (1 if bin_ <= model.bin[t, node] else 2)
        raw += model.leaf[t, node - model.feature.shape[1]]
    return 1 / (1 + math.exp(-raw))


def test_url_filter(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    urls = {r["page_id"]: r["url"] or "" for r in pages.collect()}
    judged = url_filter.judged(pages, "page_id", "url", url_filter.RULES)
    model = url_filter.fit(judged.withColumn("verdict", url_filter.verdict_of(judged["rule"], url_filter.RULES)).filter("verdict is not null"))
    for r in url_filter.op7_url_filter(spark, SF).collect():
        p = walked(model, features(urls[r["page_id"]], r["host"], r["path"], model.suffixes))
        assert abs(p - r["score"]) < 1e-9
        assert r["verdict"] == (dict((t, v) for v, t in url_filter.RULES)[r["rule"]] if r["rule"] else "block" if p > 0.5 else "allow")


# Media: the WAV's own bytes, and a transform summed term by term


def spectrum(frame):
    n = len(frame)
    weighted = [v * (0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1))) for k, v in enumerate(frame)]
    turns = [cmath.exp(-2j * math.pi * k / n) for k in range(n)]
    return [round(abs(sum(v * turns[k * b % n] for k, v in enumerate(weighted))) * 16) for b in range(n // 2 + 1)]


def codes_of(payload):
    frames = 1 + max(0, -(-(len(payload) - 256) // 128))
    found = []
    for t in range(frames):
        own = [b - 128 for b in payload[t * 128 : t * 128 + 256]]
        mag = spectrum(own + [0] * (256 - len(own)))
        floor = sum(mag[1:]) / 128
        row = []
        for lo, hi in ((1, 8), (8, 20), (20, 44), (44, 129)):
            best = max(range(lo, hi), key=lambda b: (mag[b], -b))
            row.append(best if mag[best] > 2 * floor else 0)
        found.append(row)
    return sorted(t << 32 | band << 18 | found[t][band] << 10 | found[t + gap][band] << 2 | gap
                  for t in range(frames) for gap in (1, 2, 3) if t + gap < frames for band in range(4) if found[t][band] and found[t + gap][band])


def test_media(spark, texts):
    rows = {r["doc_id"]: r for r in media.op8_media_columns(spark, SF).collect()}
    few = random.Random(4).sample(sorted(i for i, t in texts.items() if len(t) < 1500), 12)
    for i, t in texts.items():
        raw = t.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"], r["tail_crc32"]) == (len(raw), len(payload), len(head) + len(payload), zlib.crc32(payload[-64:]))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(head + payload).hexdigest())
        if i in few:
            codes = codes_of(payload)
            # magnitudes on a rounding border may fall to either side
            assert len(set(codes) ^ set(r["fingerprint"])) <= 2
            assert r["feature"] == f"{len(r['fingerprint'])}:{hashlib.sha256(struct.pack(f'<{len(r['fingerprint'])}q', *r['fingerprint'])).hexdigest()}"


def test_repeated_rows_give_repeated_results(spark):
    rows = [(1, "token = abcdef123456 and words\nhttp"), (1, "token = abcdef123456 and words\nhttp"), (1, "another text"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tilewright.llm import secret_scan

    for found in (media.media_features(media.media_column(docs)), secret_scan.secret_spans(docs), language_id.predict(docs, language_id.fit_documents(docs.selectExpr("*", "'en' as lang")))):
        got = sorted(str(tuple(r)) for r in found.collect())
        assert len(got) == 5 and len(set(got)) <= 3  # equal rows, equal results
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (1, "http://b.net/y")], "page_id long, url string")
    assert len({tuple(r) for r in url_filter.url_filter(pages).collect()}) == 2 and url_filter.url_filter(pages).count() == 3
