"""Near-duplicate documents: SetSketch registers, banded, judged by likelihood, confirmed on whole sets."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.components import components
from forecourt.llm.support import BROADCAST_ROWS, Work, carried, unpacked
from forecourt.llm.words import mixed, portions, word_hashes
from forecourt.plans.joins import keyed_join

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Registers of a sketch, and how many of them make a band: a pair of similarity 0.75
#: shares no band with a chance of (1 - 0.75**4)**32, about 5 in a million.
REGISTERS, BAND = 128, 4
#: Spacing and scale of the registers, and their largest value.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
#: A pair is confirmed on whole sets if its estimate lies at most so far below the bound:
#: five standard deviations of the estimate at 0.75.
SLACK = 0.2
#: Members of a bucket that are compared with as many others in one step, and about how many shingles these may have.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
OUTPUT = ("doc_id", "n_shingles", "component_id", "kept", "stays")

_RANDOM = np.random.default_rng(7)
_TIMES = _RANDOM.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_ROLL = mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one for them all."""
    words, firsts = word_hashes(data, offsets)
    runs = max(0, len(words) - SHINGLE + 1)
    rolled = np.zeros(runs, np.uint64)
    for i in range(SHINGLE):
        rolled += words[i : i + runs] * _ROLL[i]
    rolled = mixed(rolled)
    for p, q in zip(firsts[:-1], firsts[1:], strict=True):
        if q - p >= SHINGLE:
            yield np.unique(rolled[p : q - SHINGLE + 1])
        elif q > p:
            yield mixed(np.array([(words[p:q] * _ROLL[: q - p]).sum() + np.uint64(q - p)], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of a set: per register the truncated, exponentially spaced least of the elements' values.

    Sketches merge by the larger register. The least of uniform numbers becomes exponential of ``RATE``
    per element, and its logarithm to ``BASE`` is cut to whole numbers of 16 bits.
    """
    least = np.full(REGISTERS, 2**32 - 1, dtype=np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 4096):
        np.minimum(least, (np.multiply.outer(_TIMES, high[i : i + 4096]) + _PLUS[:, None]).min(axis=1), out=least)
    waited = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(waited) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in portions(batch.column("text")):
            sizes, prints, sketches = [], [], []
            for s in shingle_sets(data, offsets):
                sizes.append(len(s))
                prints.append(np.array([s.sum(), mixed(s).sum()]).tobytes() if len(s) else None)
                sketches.append(registers(s).tobytes() if len(s) else None)
            part = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("row"), part.column("digest"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "row", "digest", "n_shingles", "print", "sketch"],
            )


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in portions(batch.column("text")):
            sets = [s.view(np.int64) for s in shingle_sets(data, offsets)]
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(first, end - first), pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(sets)))],
                names=["node", "shingles"],
            )


def _chance(x: np.ndarray) -> np.ndarray:
    """The chance that one register exceeds the other, for a surplus ``x`` of the union's elements."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def joint_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair, from the numbers of larger, smaller and equal
    registers and the sets' sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    tiny = 1e-12

    def likelihood(j):
        p, q = _chance(np.maximum(u - v * j, 0)), _chance(np.maximum(v - u * j, 0))
        return more * np.log(p + tiny) + less * np.log(q + tiny) + same * np.log(np.maximum(1 - p - q, 0) + tiny)

    for _ in range(30):  # it has one peak
        third = (high - low) / 3
        up = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(up, low + third, low), np.where(up, high, high - third)
    return (low + high) / 2


def _unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may be links by their sketches."""
    for batch in batches:
        if batch.num_rows:
            sizes = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
            j = joint_similarity(_unpacked(batch.column("sketch_a")), _unpacked(batch.column("sketch_b")), *sizes)
            keep = pa.array(j >= PERCENT / 100 - SLACK)
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(keep)


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between different components of one block or two: whole sets of the pairs that may be links by their
    sketches, the likeliest first, until every two components are linked or all their pairs are compared.

    A pair that shares several bands is compared in the bucket of the first one only.
    """
    out = []
    left, right = rows[rows["own"] == rows["low"]], rows[rows["own"] == rows["high"]]
    if rows["label"].nunique() > 1 and len(left) and len(right):
        a, b = (np.frombuffer(b"".join(side["sketch"]), dtype=np.uint16).reshape(-1, REGISTERS) for side in (left, right))
        (na, la, ia), (nb, lb, ib) = ([side[c].to_numpy() for c in ("n", "label", "node")] for side in (left, right))
        sa, sb = left["shingles"].to_numpy(), right["shingles"].to_numpy()
        band, joined, pairs = int(rows["band"].iat[0]), {}, []
        for i in range(0, len(left), 32):
            some = slice(i, i + 32)
            fits = 100 * np.minimum.outer(na[some], nb) >= PERCENT * np.maximum.outer(na[some], nb)
            x, y = np.nonzero(fits & (la[some, None] != lb))
            x += i
            same = a[x] == b[y]
            near = same.sum(axis=1) >= (PERCENT / 100 - 1.25 * SLACK) * REGISTERS
            near &= same.reshape(-1, REGISTERS // BAND, BAND).all(axis=2).argmax(axis=1) == band
            x, y = x[near], y[near]
            if len(x):
                likely = joint_similarity(a[x], b[y], na[x].astype(float), nb[y].astype(float))
                kept = likely >= PERCENT / 100 - SLACK
                pairs.append(np.stack([x[kept], y[kept], -likely[kept]]))
        if pairs:
            x, y, unlikely = np.concatenate(pairs, axis=1)

            def root(label: int) -> int:
                while joined.get(label, label) != label:
                    label = joined[label]
                return label

            for i in np.argsort(unlikely, kind="stable"):
                p, q = int(x[i]), int(y[i])
                one, other = root(la[p]), root(lb[q])
                if one == other:
                    continue
                common = len(np.intersect1d(sa[p], sb[q], assume_unique=True))
                if 100 * common >= PERCENT * (na[p] + nb[q] - common):
                    joined[max(one, other)] = min(one, other)
                    out.append((int(ia[p]), int(ib[q])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


_PAIR = "a long, b long, n_a long, n_b long"


def _ratio() -> Column:
    return 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")


class _Links:
    """Confirms candidate pairs on whole sets, which are made again from the texts of the nodes in them."""

    def __init__(self, work: Work, docs: DataFrame, nodes: DataFrame):
        self.work, self.docs, self.nodes = work, docs, nodes

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b, n_a, n_b) of fitting sizes, judged by their sketches."""
        sketch = self.nodes.select("node", "sketch")
        for side in ("a", "b"):
            pairs = pairs.join(sketch.withColumnsRenamed({"node": side, "sketch": f"sketch_{side}"}), side)
        return pairs.mapInArrow(_likely, _PAIR)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """The whole sets of the nodes in ``wanted``, stored: (node, shingles)."""
        texts = self.work.store(self.nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", "digest"))
        # A text that many documents share is dealt to many tasks.
        found = keyed_join(self.docs.select("digest", "text"), texts, ["digest"], max_rows=BROADCAST_ROWS).groupBy("node").agg(F.first("text").alias("text"))
        return self.work.store(found.mapInArrow(_whole_sets, "node long, shingles array<long>"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        pairs = stored = self.work.store(pairs)
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        for side in ("b", "a"):
            pairs = pairs.join(sets.withColumnsRenamed({"node": side, "shingles": f"set_{side}"}), side)
        common = F.size(F.array_intersect("set_a", "set_b"))
        test = 100 * common >= PERCENT * (F.col("n_a") + F.col("n_b") - common)
        links = self.work.store(pairs.filter(test).select("a", "b"))
        self.work.drop(sets, stored)
        return links


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = (), work: Work | None = None) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of 0.75 or more.

    Equal sets are one node. Bands of a node's sketch put it into buckets. Every member of a bucket is
    compared with the bucket's hub, and where several components are left, with three more hubs; links join nodes to
    components. Buckets that still hold several components are compared in blocks, members of different
    components only. So a group of thousands of copies costs a few pairs for each copy, and more only for copies
    that none of the hubs reach. Candidates of fitting sizes are judged by the joint likelihood of their
    sketches and confirmed by the intersection of their whole sets.

    Returns per document doc_id, n_shingles, component_id (the smallest doc_id reachable), kept
    (doc_id is component_id) and stays, true for one row of each component. Null and empty texts and
    texts without words have no shingles, are linked with nothing and stay. A null doc_id is
    linked like others but names no component unless nothing else does; it is kept only then.
    Rows with the same id are documents of their own. An empty table gives no rows. With columns to
    ``carry``, those not named like an output column are handed through; the texts are then stored once.
    """
    work = work or Work(docs.sparkSession)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.md5("text").alias("digest"), "text",
        carried(docs, carry, OUTPUT).alias("carried"),
    )
    if carry:
        docs = work.store(docs)
    sketches = work.store(
        docs.select("doc_id", "row", "digest", "text")
        .mapInArrow(_sketches, "doc_id long, row long, digest string, n_shingles long, print binary, sketch binary")
    )
    first = F.min_by(F.struct("digest", "sketch", F.col("n_shingles").alias("n")), "row")
    nodes = work.store(
        sketches.filter("n_shingles > 0").groupBy("print")
        .agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), first.alias("first"))
        .select("print", "node", "least_id", "first.*")
    )
    links = _links(work, docs, nodes)
    labels = components(work, links)

    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    ids = work.store(named.join(least, "label").select("print", "component_id", "label"))
    placed = sketches.select("doc_id", "row", "n_shingles", "print").join(ids, "print", "left")
    placed = work.store(
        placed.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .drop("print")
    )
    work.keep(placed, docs)
    chosen = placed.filter("kept AND n_shingles > 0").groupBy("label").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("chosen"))
    judged = placed.join(chosen, "row", "left").withColumn("stays", F.coalesce("chosen", F.lit(False)) | (F.col("n_shingles") == 0))
    if carry:
        judged = judged.join(docs.select("row", "carried"), "row")
    return judged.select(*OUTPUT, *unpacked(carry, OUTPUT))


def _links(work: Work, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    width = 2 * BAND
    band = lambda i: F.xxhash64(i, F.substring("sketch", i * width + 1, F.lit(width)))
    posted = nodes.select("node", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), band)).alias("band", "bucket"))
    drawn = lambda turn: F.min_by(F.struct("node", "n"), F.struct(F.xxhash64(F.lit(turn), "node"), "node"))
    buckets = work.store(
        posted.groupBy("bucket").agg(F.count("*").alias("members"), drawn(0).alias("hub")).filter("members > 1")
    )
    shared = work.store(posted.join(buckets, "bucket"))
    judge = _Links(work, docs, nodes)
    links = judge.confirmed(judge.likely(_stars(shared, ["hub"])))
    more = _split(work, shared.filter("members > 2").select("bucket", "band", "node", "n"), components(work, links))
    links = work.store(links.unionByName(judge.confirmed(judge.likely(_stars(more.filter("members > 2"), ["hub_1", "hub_2", "hub_3"])))))
    rest = _split(work, more.select("bucket", "band", "node", "n"), components(work, links))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("held") / BLOCK_SHINGLES)).cast("long")
    rest = (
        rest.select("bucket", "band", "node", "n", "label", "members", "held")
        .join(nodes.select("node", "sketch"), "node").join(judge.sets(rest), "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    )
    met = (
        rest.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        .groupBy("bucket", "low", "high").applyInPandas(_block_links, "a long, b long")
    )
    return work.store(links.unionByName(met))


def _stars(shared: DataFrame, hubs: list[str]) -> DataFrame:
    """Distinct pairs of a bucket's hub and another member of fitting size; of another component where these are known."""
    pairs = shared.withColumn("of", F.explode(F.array(*hubs))).filter("node <> of.node")
    if "label" in shared.columns:
        pairs = pairs.filter("label <> of.label")
    swap = F.col("of.node") > F.col("node")
    side = lambda c: (F.when(swap, F.col(c)).otherwise(F.col(f"of.{c}")), F.when(swap, F.col(f"of.{c}")).otherwise(F.col(c)))
    (a, b), (n_a, n_b) = side("node"), side("n")
    return pairs.select(a.alias("a"), b.alias("b"), n_a.alias("n_a"), n_b.alias("n_b")).filter(_ratio()).distinct()


def _split(work: Work, shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with new hubs."""
    labelled = work.store(shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    hub = lambda turn: F.min_by(F.struct("node", "n", "label"), F.struct(F.xxhash64(F.lit(turn), "node"), "node"))
    split = (
        labelled.groupBy("bucket")
        .agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("members"), F.sum("n").alias("held"), *[hub(i).alias(f"hub_{i}") for i in (1, 2, 3)])
        .filter("least <> most").drop("least", "most")
    )
    return work.store(labelled.join(split, "bucket"))
