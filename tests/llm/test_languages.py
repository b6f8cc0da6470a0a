"""Languages: held-out accuracy, forward-backward against sums over all paths, features against slices of bytes."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.llm import languages
from forecourt.llm.words import NO_LETTER, mixed, word_hashes, word_spans


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = languages.identify_held_out(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["text"] and any(c.isalpha() for c in r["text"])]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def random_field(k, seed):
    random = np.random.default_rng(seed)
    return languages.Field(list("abcde"[:k]), None, None, None, None, random.normal(size=(k, k))), random


@pytest.mark.parametrize("k", [1, 2, 3])
def test_marginals_are_sums_over_paths(k, monkeypatch):
    monkeypatch.setattr(languages, "BLOCK", 2)
    field, random = random_field(k, k)
    counts = [0, 3, 1, 6, 0, 5, 2]
    said = random.normal(size=(sum(counts), k)) * 3
    got = field.marginals(said, np.concatenate([[0], np.cumsum(counts)]))
    at = 0
    for n in counts:
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            weight = np.exp(sum(said[at + i, c] for i, c in enumerate(path)) + sum(field.step[a, b] for a, b in itertools.pairwise(path)))
            for i, c in enumerate(path):
                want[i, c] += weight
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True) if n else want, atol=1e-9)
        at += n


def test_blocks_do_not_matter(monkeypatch):
    field, random = random_field(4, 9)
    counts = [1, 31, 32, 33, 5000, 64]
    said, firsts = random.normal(size=(sum(counts), 4)) * 4, np.concatenate([[0], np.cumsum(counts)])
    whole = field.marginals(said, firsts)
    assert np.allclose(whole.sum(axis=1), 1)
    monkeypatch.setattr(languages, "BLOCK", 6000)
    assert np.allclose(whole, field.marginals(said, firsts), atol=1e-9)
    again, pairs = languages._sequence_marginals(said[None, 97:5097], field.step)
    assert np.allclose(again[0], whole[97:5097], atol=1e-9) and np.isclose(pairs.sum(), 4999)


def test_features_are_affixes_and_grams():
    texts = ["a", "né x", "straße ça"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, ends, _ = word_spans(data, offsets, NO_LETTER)
    found, bounds = languages.features(data, starts, ends)
    for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
        word = b"\x01" + data[s:e].tobytes() + b"\x02"
        grams = [word[j : j + n] for n in (2, 3) for j in range(len(word) - n + 1)]
        grams += {(j, word[j : j + 4]) for j in (0, len(word) - 4)} if len(word) >= 4 else []
        grams = [g[1] if isinstance(g, tuple) else g for g in grams]
        want = mixed(np.array([int.from_bytes(g, "big") + (len(g) << 56) for g in grams], np.uint64)) >> np.uint64(64 - languages.BITS)
        assert sorted(want.tolist()) == sorted(found[bounds[i] : bounds[i + 1]].tolist())


def test_switched_text_has_spans(spark, documents):
    long = documents.filter(F.length("text") > 1500)
    halves = {r["lang"]: r["text"] for r in long.select("lang", "text").collect()}
    words = lambda lang: halves[lang].split()[20:80]
    text = " ".join([*words("en"), *words("fr"), *words("de")])
    mixed_text = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = languages.identify_languages(mixed_text, documents, spans=True).first()
    n = len(word_hashes(np.frombuffer(text.lower().encode(), np.uint8), np.array([0, len(text.lower().encode())]), NO_LETTER)[0])
    assert row["spans"][0]["first"] == 0 and sum(s["words"] for s in row["spans"]) == n
    most = {lang: sum(s["words"] for s in row["spans"] if s["lang"] == lang) for lang in ("en", "fr", "de")}
    assert all(abs(m - n / 3) < n / 10 for m in most.values())


def test_odd_rows(spark, documents, odd_documents, no_documents):
    out = languages.identify_languages(odd_documents, documents, spans=True, carry=tuple(odd_documents.columns))
    assert len(out.columns) == len(set(out.columns))
    rows = out.collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["spans"]) == ("und", 0.0, None)
        else:
            assert r["lang_pred"] in ("de", "en", "es", "fr") and r["spans"]
    marks = spark.createDataFrame([(1, "— 12 。"), (2, "—"), (3, "x")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in languages.identify_languages(marks, documents).orderBy("doc_id").collect()] == [True, True, False]
    assert languages.identify_languages(no_documents, documents).count() == 0
    for labelled in (no_documents, documents.withColumn("lang", F.lit(None).cast("string")), documents.withColumn("text", F.lit("12 3."))):
        assert {r["lang_pred"] for r in languages.identify_languages(documents, labelled).collect()} == {"und"}
    short = documents.select("doc_id", "lang", F.substring_index("text", " ", 3).alias("text"))
    taught = {r["lang_pred"] for r in languages.identify_languages(documents, short).collect()}
    assert {"de", "en", "es", "fr"} <= taught
    one = languages.identify_languages(documents.filter("text <> ''"), documents.withColumn("lang", F.lit("xx"))).collect()
    assert {r["lang_pred"] for r in one} <= {"xx", "und"} and all(r["score"] == 1 for r in one if r["lang_pred"] == "xx")
