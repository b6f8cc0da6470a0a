import math

import numpy as np

from forecourt.llm.url_filter import RULES, filter_urls
from forecourt.llm.vector_search import Tree, nearest_vectors


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def ruled(host, path):
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def check_urls(pages):
    rows = filter_urls(pages).collect()
    urls = pages.select("page_id", "url").collect()
    assert len(rows) == len(urls)
    want = sorted(((r["page_id"], *split(r["url"]), ruled(*split(r["url"]))[0]) for r in urls), key=repr)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in rows), key=repr) == want
    for r in rows:
        verdict = ruled(r["host"], r["path"])[1]
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    return rows


def test_pages(spark):
    rows = check_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    known = [r for r in rows if r["rule"]]
    agree = sum((r["score"] >= r["threshold"]) == (r["verdict"] == "allow") for r in known)
    assert agree >= 0.85 * len(known)


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.example.com/en", "http://com/",
            "http://xcom/", "http://b.net/fr/1", "http://b.net?/fr/", "http://b.net#f", "http://ü.org/é" + "x" * 100_000, "http://a.com//en/", "x://y://z.net/es/"]
    pages = spark.createDataFrame([(i % 5 or None, u, "r", 1.0) for i, u in enumerate(urls + urls[:4])], "page_id long, url string, rule string, score double")
    check_urls(pages)
    assert check_urls(pages.limit(0)) == []
    only = filter_urls(spark.createDataFrame([(1, None), (2, "http://a.org/")], "page_id long, url string")).collect()
    assert [(r["verdict"], r["score"]) for r in only] == [("allow", 0.0)] * 2


def brute(rows, k=5, every=50):
    good = [(i, np.array(v, dtype=float), n) for n, (i, v) in enumerate(rows)
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q, n in good:
        if i % every == 0:
            near = sorted((-float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), j) for j, v, _ in good if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near)]
    return sorted(out)


def check_vectors(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, row string")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in nearest_vectors(df, **options).collect())
    assert got == brute(rows)


def test_nearest_in_clusters_and_ties(spark):
    random = np.random.default_rng(3)
    centres = random.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.1 * random.normal(size=16)).tolist()) for i in range(900)]
    rows += [(i, centres[0].tolist()) for i in range(900, 1300)]  # one common vector
    check_vectors(spark, rows, shard_rows=300, block_queries=5)


def test_odd_vectors(spark):
    check_vectors(spark, [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
                          (7, [2.0, 0.0]), (50, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (8, [-1.0, 0.5]), (100, [0.5, 0.5])])
    check_vectors(spark, [])


def test_a_relaxed_tree_searches_less_with_high_recall():
    random = np.random.default_rng(4)
    centres = random.normal(size=(60, 24))
    data = centres[random.integers(0, 60, 6000)] + 0.25 * random.normal(size=(6000, 24))
    tree, ids = Tree(np.arange(6000), data), np.arange(0, 6000, 50)
    _, exact = tree.search(ids, data[ids], 5, 1.0)
    _, relaxed = tree.search(ids, data[ids], 5, 1.5)
    units = data / np.linalg.norm(data, axis=1, keepdims=True)
    near = units[ids] @ units.T
    near[np.arange(len(ids)), ids] = -2
    truth = np.argsort(-near, axis=1)[:, :5]
    recall = lambda found: np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, truth, strict=True)])
    assert recall(exact) == 1 and recall(relaxed) >= 0.9


def test_very_large_and_very_small_values(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [1e-200, 2e-200]), (3, [5.0, 1.0]), (4, [0.0, -1e308]), (50, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in nearest_vectors(df).collect()}
    unit = {i: (v[0] / max(map(abs, v)), v[1] / max(map(abs, v))) for i, v in rows}
    cosine = lambda a, b: (a[0] * b[0] + a[1] * b[1]) / (a[0] ** 2 + a[1] ** 2) ** 0.5 / (b[0] ** 2 + b[1] ** 2) ** 0.5
    assert len(found) == 10 and all(abs(s - cosine(unit[q], unit[i])) < 1e-12 for (q, i), s in found.items())


def test_blocks_hold_so_many_queries_whatever_the_ids(spark):
    df = spark.range(300).selectExpr("id * 50 AS vec_id", "array(cos(id), sin(id), 1D) AS embedding")
    one, many = nearest_vectors(df).collect(), nearest_vectors(df, block_queries=20, shard_rows=70).collect()
    assert sorted(one) == sorted(many) and len(one) == 1500
