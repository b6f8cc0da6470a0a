import re

import numpy as np
import pyarrow as pa
import pytest

from forecourt.llm import near_dups as N
from forecourt.llm.words import portions, word_hashes

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute(rows):
    """doc_id, size, component, kept by comparing all texts with all."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x, s in zip(rows, label, sets, strict=True):
        if s and i is not None:
            least[x] = min(least.get(x, i), i)
    out = []
    for (i, _), x, s in zip(rows, label, sets, strict=True):
        c = least.get(x) if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=repr)


def found(docs):
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in N.near_duplicates(docs).select(*columns).collect()), key=repr)


def test_equals_brute_force(documents):
    assert found(documents) == brute([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])


@pytest.fixture(scope="module")
def copies(spark):
    random = np.random.default_rng(1)
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(50)]  # exact copies
    for i in range(50, 250):  # near copies, many of which are not links of each other
        words = list(base)
        for at in random.integers(0, 120, random.integers(1, 6)):
            words[at] = f"n{random.integers(10**6)}"
        rows.append((i, " ".join(words)))
    shared = " ".join(base[:60])  # a passage that many other documents share
    rows += [(i, shared + " " + " ".join(f"u{random.integers(10**6)}" for _ in range(40 + i % 30))) for i in range(250, 400)]
    return rows


def test_large_groups_of_copies(spark, copies, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 800)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    assert found(spark.createDataFrame(copies, "doc_id long, text string")) == brute(copies)


def test_odd_rows(odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()]
    assert found(odd_documents) == brute(rows)
    kept = N.near_duplicates(odd_documents, carry=tuple(odd_documents.columns))
    assert set(N.OUTPUT) <= set(kept.columns) and "size" in kept.columns
    stays = kept.filter("stays").collect()
    assert sorted((r["doc_id"] for r in stays), key=str) == sorted([1, 2, 3, 4, 5, 6, 8, 8, None, None], key=str)


def test_no_rows(no_documents):
    assert N.near_duplicates(no_documents).count() == 0


def test_words_are_told_apart():
    texts = ["aB c", "ab  c\n", "abc", "", None, "x" * 100 + " " + "x" * 99, "é É", "a b c d e f"]
    data = list(portions(pa.array(texts)))
    assert [d[:2] for d in data] == [(0, 8)]
    hashes, firsts = word_hashes(*data[0][2:])
    words = [hashes[p:q].tolist() for p, q in zip(firsts[:-1], firsts[1:], strict=True)]
    assert [len(w) for w in words] == [2, 2, 1, 0, 0, 2, 2, 6]
    assert words[0] == words[1] and len({w for ws in words for w in ws}) == 2 + 1 + 2 + 2 + 5


def test_sketches_merge_and_estimate():
    random = np.random.default_rng(2)
    pool = random.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    assert (N.registers(np.union1d(a, b)) == np.maximum(N.registers(a), N.registers(b))).all()
    estimate = N.joint_similarity(N.registers(a)[None], N.registers(b)[None], np.array([2000.0]), np.array([2000.0]))
    assert abs(estimate[0] - 1500 / 2500) < 0.15
