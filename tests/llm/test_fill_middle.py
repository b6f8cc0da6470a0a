"""Fill-in-the-middle against regular expressions, and the wavelet matrix against counting."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from forecourt.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_rank_counts():
    random = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = random.integers(0, 6, n).astype(np.uint8)
        matrix = fill_middle.WaveletMatrix(symbols, 3)
        i = np.arange(n + 1)
        for symbol in range(8):
            assert (matrix.rank(symbol, i) == np.concatenate([[0], np.cumsum(symbols == symbol)])).all()


def test_every_cut_of_odd_texts():
    texts = ["", " ", "a", " a", "a ", " \t\na  bc\x0b", "né ü\x0cß 語語 \U0001f697\U0001f697 x", "\x1fa\x85b\xa0c", "  \n"]
    for text in texts:
        units = UNIT.findall(text)
        for a in range(len(units) + 1):
            for b in range(len(units) + 1):
                got = fill_middle._cuts(pa.array([text, text]), pa.array([a, b]), pa.array([b, a])).to_pylist()
                low, high = min(a, b), max(a, b)
                assert got == [{"n": len(units), "prefix_chars": len("".join(units[:low])), "middle_chars": len("".join(units[low:high]))}] * 2


def test_documents_round_trip(spark, documents, odd_documents, no_documents):
    marks = spark.createDataFrame([(i, t, "en", "a", 1) for i in range(40) for t in ("<P>x y", "a <S b< S> <M c", "<>S> P> <", "x <M> y", "\U0001f697 é \n")], documents.schema)
    for docs in (documents, marks, odd_documents):
        rows = fill_middle.rearranged(docs, carry=("text",)).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected(r["doc_id"], r["text"])
            assert r["again"] == (r["text"] or "")
    assert {r["form"] for r in fill_middle.rearranged(documents).collect()} == {"plain", "psm", "spm"}
    assert fill_middle.rearranged(no_documents).count() == 0
    out = fill_middle.rearranged(odd_documents, carry=tuple(odd_documents.columns)).columns
    assert len(out) == len(set(out))


@pytest.mark.parametrize("shares", [(0, 80), (100, 0), (100, 100)])
def test_shares(spark, documents, shares):
    forms = {r["form"] for r in fill_middle.rearranged(documents.filter("text <> ''"), transformed=shares[0], spm=shares[1]).collect()}
    assert forms <= {"plain", {(0, 80): "plain", (100, 0): "psm", (100, 100): "spm"}[shares]}
