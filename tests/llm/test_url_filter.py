import re

import numpy as np

from tilewright.llm import url_filter as m


def judge(url, rules=m.RULES):
    url = url or ""
    _, sep, rest = url.partition("://")
    host = re.split("[/?#]", rest)[0] if sep else ""
    path = re.split("[?#]", rest[len(host) :])[0] if sep else ""
    host = host.translate({k: k + 32 for k in range(65, 91)})
    fits = [(len(t), t) for _, t in rules if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return host, path, max(fits)[1] if fits else None


URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://A.Example.ORG/es/x?y#z", "https://example.org/en/1", "https://example.org/en/12", "https://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/1?u=http://b.org/",
    "http://x.com/de", "http://x.com/de/", "http://x.net/a/b?c=1&d=2#e", "ftp://x.com?q", "http://x.com#f/de/", "://org/", "http://É.org/", "a://b://org/", "http://com/fr/", "http://x.org\n/es/", "http://" + "a" * 100_000 + ".com/de/",
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://x.org/", "h")], "page_id long, url string, host string")
    rows = m.url_filter(df).collect()
    verdicts = {t: v for v, t in m.RULES}
    for r in rows:
        url = "http://x.org/" if r["id"] is None else URLS[r["id"]]
        assert (r["host"], r["path"], r["rule"]) == judge(url)
        assert r["verdict"] == verdicts[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")
    assert len(rows) == len(URLS) + 1 and m.url_filter(df.limit(0)).count() == 0
    assert {r["verdict"] for r in m.url_filter(df, rules=()).collect()} == {"allow"}


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        bad = rng.random() < 0.4
        host = ("x" + "".join(rng.choice(list("0123456789"), 12)) if bad else "site") + ".net"
        out.append((f"https://{host}/" + "/".join("abc"[: rng.integers(1, 4)] for _ in range(rng.integers(1, 6 if bad else 4))), host, "/", "block" if bad else "allow"))
    return out


def test_trees_learn_held_out_urls(spark):
    model = m.fit(spark.createDataFrame(labelled(600, 1), "url string, host string, path string, verdict string"))
    test = labelled(300, 2)
    p = m.block_probability(model, m.lexical([u for u, *_ in test], [h for _, h, *_ in test], [q for *_, q, _ in test], model.suffixes))
    assert np.mean((p > 0.5) == np.array([v == "block" for *_, v in test])) > 0.95


def test_features():
    x = dict(zip(m.FEATURES, m.lexical(["https://a-b.c.net/x1/y?k=1&l=2#f"], ["a-b.c.net"], ["/x1/y"], {"": (0.5, 0.0), "net/": (0.25, 8.0), "net/x1/": (0.75, 2.0)})[0], strict=True))
    assert (x["depth"], x["parameters"], x["labels"], x["hyphens"], x["has_fragment"], x["is_https"], x["suffix_rate"], x["domain_rate"], x["section_rate"]) == (2, 2, 3, 1, 1, 1, 0.25, 0.5, 0.75)
    assert x["digit_ratio"] == 3 / 32 and 3 < x["entropy"] < 5


def test_held_out_accuracy_on_the_rules_own_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = m.judged(pages, "page_id", "url", m.RULES).withColumn("verdict", m.verdict_of(m.F.col("rule"), m.RULES)).filter("verdict is not null")
    model = m.fit(rows.filter("id % 2 = 0"))
    test = rows.filter("id % 2 = 1").toPandas()
    p = m.block_probability(model, m.lexical(test["url"].tolist(), test["host"].tolist(), test["path"].tolist(), model.suffixes))
    assert np.mean((p > 0.5) == (test["verdict"] == "block").to_numpy()) > 0.9


def test_a_rows_own_label_is_not_among_its_features():
    rng = np.random.default_rng(3)
    hosts = [f"h{rng.integers(0, 40)}.s{rng.integers(0, 9)}.net" for _ in range(300)]
    urls, paths, y = [f"http://{h}/p/{k}" for k, h in enumerate(hosts)], [f"/p/{k}" for k in range(300)], rng.integers(0, 2, 300).astype(float)
    x = m.out_of_fold(urls, hosts, paths, y)
    for k in (0, 7, 299):
        flipped = y.copy()
        flipped[k] = 1 - y[k]
        assert (m.out_of_fold(urls, hosts, paths, flipped)[k] == x[k]).all()
    assert m.out_of_fold([], [], [], np.zeros(0)).shape == (0, len(m.FEATURES))


def test_one_url_of_a_third_of_all_rows_is_one_row_of_the_sample(spark):
    rows = labelled(400, 5)
    seen = spark.createDataFrame(rows + [rows[0]] * 200 + [(None, None, None, "allow"), ("http://q.net/", "q.net", "/", None)], "url string, host string, path string, verdict string")
    once = m.fit(spark.createDataFrame(rows + [(None, None, None, "allow")], "url string, host string, path string, verdict string"))
    model = m.fit(seen)
    assert model.suffixes == once.suffixes and (model.leaf == once.leaf).all() and max(n for _, n in model.suffixes.values()) <= 401


def test_held_out_hosts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = m.judged(pages, "page_id", "url", m.RULES).withColumn("verdict", m.verdict_of(m.F.col("rule"), m.RULES)).filter("verdict is not null")
    right = total = 0
    for fold in range(5):
        model = m.fit(rows.filter(f"pmod(crc32(host), 5) != {fold}"))
        test = rows.filter(f"pmod(crc32(host), 5) = {fold}").toPandas()
        p = m.block_probability(model, m.lexical(test["url"].tolist(), test["host"].tolist(), test["path"].tolist(), model.suffixes))
        right, total = right + ((p > 0.5) == (test["verdict"] == "block").to_numpy()).sum(), total + len(test)
    print("held-out hosts", right / total)
    assert right / total > 0.9


def test_what_the_driver_gets_has_a_bound_whatever_the_urls(spark):
    rows = [(f"http://{'h' * 50_000}{i}.net/{'p' * 50_000}/", "h" * 50_000 + f"{i}.{'n' * 500}{i % 2}", "/" + "p" * 50_000 + "/", "block" if i % 2 else "allow") for i in range(40)]
    model = m.fit(spark.createDataFrame(rows, "url string, host string, path string, verdict string"))
    assert max(map(len, model.suffixes)) <= m.KEY_MOST and {n for s, (_, n) in model.suffixes.items() if s} == {1.0, 20.0}


def test_the_sample_is_the_urls_of_the_least_hashes(spark, monkeypatch):
    monkeypatch.setattr(m, "SAMPLE", 50)
    df = spark.createDataFrame(labelled(400, 5), "url string, host string, path string, verdict string")
    assert m.fit(df).suffixes == m.fit(df.repartition(9)).suffixes
    assert max(n for _, n in m.fit(df).suffixes.values()) == 50  # every host ends in net
