"""Scores of the trained operators, computed again one by one from their formulas."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from forecourt.llm import quality, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"


def test_logits_are_sums_over_pairs():
    random = np.random.default_rng(1)
    machine = toxicity.Machine(np.ones(2**toxicity.BITS, dtype=bool))
    terms = random.choice(2**toxicity.BITS, 40, replace=False)
    machine.bias = -0.7
    machine.weight[terms] = random.normal(size=40)
    machine.factor[terms] = random.normal(size=(40, machine.factor.shape[1]))
    texts = [random.choice(terms, n, replace=False) for n in (5, 0, 1, 17, 0, 2)]
    ids, starts = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    values = random.random(len(ids)).astype(np.float32)
    got, _ = machine.logits(ids, values, starts)
    for i, text in enumerate(texts):
        x = values[starts[i] : starts[i + 1]]
        expected = machine.bias + sum(float(machine.weight[t]) * float(v) for t, v in zip(text, x, strict=True))
        for a in range(len(text)):
            for b in range(a):
                expected += float(machine.factor[text[a]] @ machine.factor[text[b]]) * float(x[a]) * float(x[b])
        assert math.isclose(got[i], expected, rel_tol=1e-4, abs_tol=1e-4)


def _strength(groups, within):
    """Documents that the prior counts as, of (documents, mean, prior) of each group."""
    n = sum(g[0] for g in groups)
    if not n or len(groups) < 2:
        return 1e6
    between = max((sum(k * (mean - prior) ** 2 for k, mean, prior in groups) - len(groups) * within) / n, within * 1e-6, 1e-9)
    return min(max(within / between, 1.0), 1e6)


def _check_posteriors(rows):
    sites, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        sites[r["source"]].append(r["evidence"])
        parts[r["source"], r["lang"]].append(r["evidence"])
    every = [r["evidence"] for r in rows]
    mean = (sum(every) + 1) / (len(every) + 2)
    within = max(sum((e - sum(p) / len(p)) ** 2 for p in parts.values() for e in p) / len(every), 1e-9)
    average = lambda p: sum(p) / len(p)
    like = _strength([(len(p), average(p), mean) for p in sites.values()], within)
    site = {s: (sum(p) + like * mean) / (len(p) + like) for s, p in sites.items()}
    like = _strength([(len(p), average(p), site[key[0]]) for key, p in parts.items()], within)
    path = {key: (sum(p) + like * site[key[0]]) / (len(p) + like) for key, p in parts.items()}
    held = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    logit = lambda p: math.log(held(p) / (1 - held(p)))
    for r in rows:
        key = (r["source"], r["lang"])
        assert math.isclose(r["site_quality"], site[r["source"]], rel_tol=1e-6) and math.isclose(r["path_quality"], path[key], rel_tol=1e-6)
        words = len([w for w in (r["text"] or "").replace("\x0b", " ").replace("\x0c", " ").split() if w]) if (r["text"] or "").isascii() else None
        if words is None:
            continue
        said = words / (words + quality.FEW)
        expected = 0.0 if r["evidence"] <= 0 else 1 / (1 + math.exp(-(said * (logit(r["evidence"]) - logit(mean)) + logit(path[key]))))
        assert math.isclose(r["quality"], expected, rel_tol=1e-6, abs_tol=1e-9)
        assert r["kept"] == (r["quality"] >= quality.KEEP)


def test_posteriors_of_documents(documents, labels):
    rows = quality.judge_quality(documents, labels, carry=("text",)).collect()
    assert len({(r["source"], r["lang"]) for r in rows}) > 3
    _check_posteriors(rows)


def test_posteriors_with_null_and_sparse_groups(spark):
    texts = ["a b c", "Plain words of a short text that ends.", "### !! ||| {{", "", None, "One more sentence, and another one here.", "x " * 300]
    docs = [(i, texts[i % 7], [None, "en", "de"][i % 3], ["big", "big", "big", None, f"tiny{i}"][i % 5]) for i in range(200)]
    known = [(i, int(i % 7 in (1, 5))) for i in range(0, 200, 2)]
    judged = quality.judge_quality(
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(known, "doc_id long, quality int"), carry=("text",))
    rows = judged.collect()
    assert len(rows) == 200
    _check_posteriors(rows)


def _symbols(text):
    known = {ord(c): i for i, c in enumerate(url_filter.CHARACTERS)}
    return [known.get(b, url_filter.SYMBOLS - 2) for b in text.lower().encode()]


class _Model:
    """Witten and Bell's interpolation, context by context."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for text in texts:
            line = [url_filter.SYMBOLS - 1] * url_filter.ORDER + _symbols(text)
            for i in range(url_filter.ORDER, len(line)):
                for order in range(url_filter.ORDER + 1):
                    self.after[tuple(line[i - order : i])][line[i]] += 1

    def chance(self, context, symbol):
        shorter = self.chance(context[1:], symbol) if context else 1 / url_filter.SYMBOLS
        seen = self.after.get(context)
        return (seen[symbol] + len(seen) * shorter) / (seen.total() + len(seen)) if seen else shorter


def test_url_scores_and_threshold(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-1, None), (-2, "no scheme"), (-3, "http://"), (-4, "http://B\u00fccher.example.org/\u00e9t\u00e9?Q=1"), (-5, "x://com/")], "page_id long, url string")
    pages = pages.unionByName(odd.select(F.col("page_id").cast(dict(pages.dtypes)["page_id"]).alias("page_id"), "url"))
    rows = url_filter.filter_urls(pages).join(pages.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(url_filter.FOLDS))), "page_id").collect()
    rest = {r["page_id"]: r["url"].split("://", 1)[1] if "://" in (r["url"] or "") else "" for r in rows}
    judged = [r for r in rows if r["rule"] is not None]
    models = {kind: _Model([rest[r["page_id"]] for r in judged if r["fold"] > 0 and r["verdict"] == kind]) for kind in ("allow", "block")}
    for r in rows:
        line = [url_filter.SYMBOLS - 1] * url_filter.ORDER + _symbols(rest[r["page_id"]])
        logs = [
            math.log(models["allow"].chance(c, s)) - math.log(models["block"].chance(c, s))
            for i in range(url_filter.ORDER, len(line)) for c, s in [(tuple(line[i - url_filter.ORDER : i]), line[i])]
        ]
        assert math.isclose(r["score"], sum(logs) / len(logs) if logs else 0.0, abs_tol=1e-4)
    cut = rows[0]["threshold"]
    held = [(r["score"], r["verdict"] == "allow") for r in judged if r["fold"] == 0]
    good = sum(ok for _, ok in held)

    def errors(at):
        return sum(ok and s < at for s, ok in held) / good + sum(not ok and s >= at for s, ok in held) / (len(held) - good)

    assert 0 < good < len(held)
    assert errors(cut) <= min(errors(i / 100) for i in range(-800, 801)) + 1e-9
    for r in rows:
        if r["rule"] is None:
            assert r["verdict"] == ("allow" if not rest[r["page_id"]] or r["score"] >= cut else "block")
