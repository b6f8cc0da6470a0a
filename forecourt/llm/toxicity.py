"""Toxicity of whole texts by a factorization machine over hashed terms."""

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.support import Work, small
from forecourt.llm.words import NO_LETTER, portions, word_hashes

#: Terms are a text's runs of letters, lower-cased, and their heads of so many bytes, hashed to so many bits.
HEADS, BITS = (4, 5, 6), 18
#: A term is used if it is in so many labelled texts, and in so many standard deviations more or
#: fewer toxic ones than by chance. All labelled texts count for this. Terms that are in so many of the
#: sample's texts together, and are toxic together more or less than each alone tells, are used too.
LEAST, DEVIATIONS = 5, 3.0
#: Terms whose pairs one row of work counts, and the tasks for these rows.
PAIR_ROWS, PAIR_TASKS = 64, 48
#: Labelled rows that the machine is fitted on at most, those first by hash.
SAMPLE = 10_000
FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 100, 256, 1.0, 1e-6
FOLDS = 5


class Terms:
    """Distinct hashed terms of some texts: ``ids`` and ``values`` of text i lie in ``starts[i]:starts[i + 1]``.

    A value is the root of the term's share of the text's terms, so a text's values have length one.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, used: np.ndarray | None = None):
        whole, firsts, *heads = word_hashes(data, offsets, NO_LETTER, HEADS)
        n = len(offsets) - 1
        text = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(BITS), np.diff(firsts))
        keys = []
        for h in (whole, *heads):
            term = h >> np.uint64(64 - BITS)
            known = slice(None) if used is None else used[term]
            keys.append(text[known] | term[known])
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        self.ids = (keys & np.uint64(2**BITS - 1)).astype(np.int32)
        of = (keys >> np.uint64(BITS)).astype(np.int64)
        self.starts = np.searchsorted(of, np.arange(n + 1))
        total = np.diff(firsts)[of] * (1 + len(HEADS))
        self.values = np.sqrt(counts / total).astype(np.float32)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; 0 for an empty one."""
    out = np.zeros((len(starts) - 1, *x.shape[1:]))
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(x, starts[full], axis=0, dtype=np.float64)
    return out


class Machine:
    """score = bias + sum of weights * x + sum over pairs of terms of (their factors' product) * x * x."""

    def __init__(self, used: np.ndarray):
        self.used = used
        self.bias = 0.0
        self.weight = np.zeros(2**BITS, dtype=np.float32)
        self.factor = np.random.default_rng(3).normal(0, 0.05, (2**BITS, FACTORS)).astype(np.float32)

    def logits(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each text, and the sum of its terms' factors."""
        vx = self.factor[ids] * values[:, None]
        together = _sums(vx, starts)
        alone = _sums(vx * vx, starts)
        return self.bias + _sums(self.weight[ids] * values, starts) + 0.5 * (together**2 - alone).sum(axis=1), together

    def fit(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> None:
        """Minimise the log loss by steps that shrink with each parameter's past gradients."""
        random = np.random.default_rng(5)
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        past_w, past_v, past_b = np.full(2**BITS, 1e-6), np.full((2**BITS, FACTORS), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = random.permutation(len(labels))
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                lengths = (starts[1:] - starts[:-1])[rows]
                at = np.concatenate([[0], np.cumsum(lengths)])
                pick = np.arange(at[-1]) + np.repeat(starts[rows] - at[:-1], lengths)
                own, x = ids[pick], values[pick]
                logit, together = self.logits(own, x, at)
                off = 1 / (1 + np.exp(-logit)) - labels[rows]
                each = np.repeat(off, lengths) / len(rows)
                terms, place = np.unique(own, return_inverse=True)
                total = lambda g: np.bincount(place, g, len(terms))
                slope = total(each * x) + DECAY * self.weight[terms]
                past_w[terms] += slope**2
                self.weight[terms] -= RATE * slope / np.sqrt(past_w[terms])
                around = np.repeat(together, lengths, axis=0) - self.factor[own] * x[:, None]
                slope = np.stack([total(each * x * around[:, f]) for f in range(FACTORS)], axis=1) + DECAY * self.factor[terms]
                past_v[terms] += slope**2
                self.factor[terms] -= RATE / 10 * slope / np.sqrt(past_v[terms])
                past_b += off.mean() ** 2
                self.bias -= RATE / 10 * off.mean() / np.sqrt(past_b)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, and toxic texts, that hold each term; one row per term and task."""
    counts = np.zeros((2, 2**BITS), dtype=np.int64)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for first, end, data, offsets in portions(batch.column("text")):
            terms = Terms(data, offsets)
            of = np.repeat(toxic[first:end], np.diff(terms.starts))
            counts[0] += np.bincount(terms.ids, minlength=2**BITS)
            counts[1] += np.bincount(terms.ids[of == 1], minlength=2**BITS)
    some = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["term", "texts", "toxic"])


def _features(used):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in portions(batch.column("text")):
                terms = Terms(data, offsets, used.value)
                starts = pa.array(terms.starts.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(first, end - first), pa.ListArray.from_arrays(starts, pa.array(terms.ids)), pa.ListArray.from_arrays(starts, pa.array(terms.values))],
                    names=["toxic", "ids", "values"],
                )

    return make


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each text."""
    for batch in batches:
        for first, end, data, offsets in portions(batch.column("text")):
            terms = Terms(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").slice(first, end - first), pa.ListArray.from_arrays(pa.array(terms.starts.astype(np.int32)), pa.array(terms.ids))], names=["toxic", "ids"]
            )


class Pairs:
    """Which terms are toxic together more or less than each of them alone tells, among some texts' terms.

    By what each term alone tells, a pair's odds are the product of theirs over the odds of all texts. A pair
    departs if a binomial count bounds the chance of it, by Chernoff, below one in all ordered pairs.
    Texts of equal terms count once.
    """

    def __init__(self, texts: list[np.ndarray], toxic: np.ndarray):
        once = {(md5(t).digest(), y): i for i, (t, y) in enumerate(zip(texts, toxic.tolist(), strict=True)) if len(t)}
        texts, self.toxic = [texts[i] for i in once.values()], toxic[list(once.values())].astype(np.int64)
        ids = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        kept = np.bincount(ids, minlength=2**BITS) >= LEAST
        self.terms = np.flatnonzero(kept)
        of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])[kept[ids]]
        self.ids = (np.cumsum(kept, dtype=np.int32) - np.int32(1))[ids[kept[ids]]]
        del ids
        self.starts = np.searchsorted(of, np.arange(len(texts) + 1, dtype=np.int32))
        self.holders = of[np.argsort(self.ids, kind="stable")]
        n = np.bincount(self.ids, minlength=len(self.terms))
        self.firsts = np.concatenate([[0], np.cumsum(n)])
        share = np.clip(self.toxic.mean() if len(texts) else 0.5, 1e-9, 1 - 1e-9)
        bad = np.bincount(self.ids[self.toxic[of] == 1], minlength=len(self.terms)) + share
        self.odds = np.log(bad / (n + 1 - bad))
        self.base = np.log(share / (1 - share))
        self.bound = 2 * np.log(max(len(self.terms), 2))

    def departing(self, term: int) -> np.ndarray:
        """The terms with which this one departs."""
        texts = self.holders[self.firsts[term] : self.firsts[term + 1]]
        texts = texts[np.argsort(-self.toxic[texts], kind="stable")]  # the toxic ones first
        ids = np.concatenate([self.ids[self.starts[i] : self.starts[i + 1]] for i in texts])
        n = np.bincount(ids, minlength=len(self.terms))
        some = np.flatnonzero(n >= LEAST)
        some = some[some != term]
        toxic = texts[: self.toxic[texts].sum()]
        bad = np.bincount(ids[: int((self.starts[toxic + 1] - self.starts[toxic]).sum())], minlength=len(self.terms))[some]
        n = n[some]
        clean = n - bad
        odds = self.odds[term] + self.odds[some] - self.base
        log = lambda count, expected: count * (np.log(np.maximum(count, 1) / n) + np.logaddexp(0, expected))
        return some[log(bad, -odds) + log(clean, odds) >= self.bound]


def _departing(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value
        for batch in batches:
            chosen = np.zeros(len(pairs.terms), dtype=bool)
            for block in batch.column("id").to_pylist():
                for term in range(block * PAIR_ROWS, min((block + 1) * PAIR_ROWS, len(pairs.terms))):
                    chosen[pairs.departing(term)] = True
            yield pa.RecordBatch.from_arrays([pa.array(pairs.terms[chosen], pa.int64())], names=["term"])

    return find


def _scored(machine):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in portions(batch.column("text")):
                terms = Terms(data, offsets, machine.value.used)
                logit, _ = machine.value.logits(terms.ids, terms.values, terms.starts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(1 / (1 + np.exp(-logit)))], names=["doc_id", "score"])

    return score


def _fold(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine over the terms that all labelled documents outside the held-out fold single out and those
    that depart in pairs, fitted on at most ``sample`` of these documents, which give the pairs too."""
    spark = docs.sparkSession
    work = Work(spark)
    known = work.store(
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (_fold(F.col("doc_id")) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    labelled = lambda rows: texts.join(rows, "doc_id").select("toxic", "text")
    n, bad = known.join(texts.select("doc_id"), "doc_id").agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    used = np.zeros(2**BITS, dtype=bool)
    machine = Machine(used)
    if not 0 < bad < n:
        machine.bias = 30.0 if bad else -30.0
        return machine
    seen = labelled(small(known)).mapInArrow(_occurrences, "term long, texts long, toxic long")
    seen = seen.groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic")).filter(F.col("texts") >= LEAST)
    expected = F.col("texts") * (bad / n)
    spread = F.sqrt(expected * (1 - F.col("texts") / n) * (1 - bad / n))
    chosen = seen.filter(F.abs(F.col("toxic") - expected) >= DEVIATIONS * spread).select("term").collect()  # at most 2 ** BITS
    used[[r["term"] for r in chosen]] = True
    first = work.store(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # One text for each id, however often it is repeated: that of the least hash.
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    sampled = texts.join(F.broadcast(first), "doc_id").groupBy("doc_id", "toxic").agg(least).select("toxic", "least.text")
    table = sampled.mapInArrow(_sample_terms, "toxic int, ids array<int>").toArrow()
    lists = [c for c in table.column("ids").chunks if len(c)]
    pairs = Pairs([t for c in lists for t in np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])], table.column("toxic").to_numpy())
    del table, lists
    together = spark.range(0, -(-len(pairs.terms) // PAIR_ROWS), 1, PAIR_TASKS).mapInArrow(_departing(spark.sparkContext.broadcast(pairs)), "term long")
    used[[r["term"] for r in together.distinct().collect()]] = True  # at most 2 ** BITS
    table = sampled.mapInArrow(_features(spark.sparkContext.broadcast(used)), "toxic int, ids array<int>, values array<float>").toArrow()
    toxic = table.column("toxic").to_numpy().astype(float)
    ids, values = ([c for c in table.column(name).chunks if len(c)] for name in ("ids", "values"))
    lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in ids])
    flat = lambda chunks: np.concatenate([c.flatten().to_numpy() for c in chunks])
    machine.fit(flat(ids), flat(values), np.concatenate([[0], np.cumsum(lengths)]), toxic)
    return machine


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    The machine's terms are words and heads of words of the whole text; id, source, language and labels are no
    inputs. It learns from labelled documents whose crc32 of the id is not divisible by ``FOLDS``; for an id
    with several labels the larger counts. Repeated rows of an id are one example, with the text of the least hash.

    A null or empty text, or one without letters, gets the bias alone. A null doc_id has no checksum: not
    held out, never learned from. Repeated rows get equal scores. With labels of one kind only, scores are
    near 0 or 1 throughout, and near 0 without labels. An empty table gives no rows.
    """
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(_scored(machine), "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
