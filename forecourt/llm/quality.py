"""Document quality: classifier evidence joined with posteriors of the site and the part of the site."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.support import Work, carried, small, unpacked
from forecourt.llm.words import portions, word_hashes, word_spans

#: Labelled rows that the classifier is fitted on at most, those first by hash.
SAMPLE = 20_000
#: Documents whose posterior reaches this are kept.
KEEP = 0.5
RIDGE = 1e-2
#: A text of so many words counts half of its evidence, one of many words all of it.
FEW = 8
OUTPUT = ("doc_id", "source", "lang", "evidence", "site_quality", "path_quality", "quality", "kept")

#: Kinds of bytes whose shares are features: lower and upper case, digits, blanks, line ends, marks, others.
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "|<>[]{}", "#$%&*@^~=+_")
_KIND = np.full(256, len(_KINDS), dtype=np.int64)
_KIND[128:] = 0
for _i, _chars in enumerate(_KINDS):
    for _c in _chars:
        _KIND[ord(_c)] = _i


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text: shares of kinds of bytes, shape and variety of its words, its length. All zero without words."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    kinds = len(_KINDS) + 1
    shares = np.bincount(text * kinds + _KIND[data], minlength=n * kinds).reshape(n, kinds) / np.maximum(np.diff(offsets), 1)[:, None]
    starts, ends, firsts = word_spans(data, offsets)
    hashes, _ = word_hashes(data, offsets)
    words = np.diff(firsts)
    of = np.repeat(np.arange(n), words)
    least = np.maximum(words, 1)
    total = lambda x: np.bincount(of, x, n) / least
    keys, counts = np.unique((of.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)), return_counts=True)
    at = np.searchsorted((keys >> np.uint64(40)).astype(np.int64), np.arange(n + 1))
    distinct = np.diff(at)
    most = np.zeros(n)
    most[distinct > 0] = np.maximum.reduceat(counts, at[:-1][distinct > 0]) if len(counts) else 0
    lengths = ends - starts
    shape = np.stack([
        total(lengths) / 10, total(lengths <= 3), total(lengths > 20), distinct / least, most / least, np.log1p(words) / 5,
        np.log(np.maximum(distinct, 1)) / np.maximum(np.log(least), 1),
    ], axis=1)
    out = np.concatenate([np.log1p(100 * shares), shape], axis=1)
    return np.where((words > 0)[:, None], np.concatenate([out, out * out], axis=1), 0.0)


class Classifier:
    """Logistic regression on standardised features, fitted by Newton's method."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._with_one(x)
        self.weight = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))
            slope = z.T @ (p - good) / len(good) + RIDGE * self.weight
            bend = (z * (p * (1 - p))[:, None]).T @ z / len(good) + (RIDGE + 1e-9) * np.eye(z.shape[1])
            self.weight -= np.linalg.solve(bend, slope)

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], axis=1)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._with_one(x) @ self.weight, -30, 30)))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in portions(batch.column("text")):
            x = features(data, offsets)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("good").slice(first, end - first), rows], names=["good", "x"])


def _evidence(model):
    def judge(texts: pa.Array) -> pa.Array:
        chance, words = [np.zeros(0)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in portions(texts):
            x = features(data, offsets)
            words.append(np.diff(word_spans(data, offsets)[2]))
            chance.append(np.where(words[-1] > 0, model.value.chance(x), 0.0) if model.value else np.ones(len(x)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(chance)), pa.array(np.concatenate(words))], names=["evidence", "words"])

    return F.arrow_udf(judge, "evidence double, words long")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """The classifier, or None without labels of both kinds.

    Fitted on at most ``sample`` labelled ids, chosen by a hash, with one text each. For several labels of an id the lower counts.
    """
    known = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    # One text for each id, however often it is repeated: that of the least hash.
    texts = texts.groupBy("doc_id", "good").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    table = texts.select("good", "least.text").mapInArrow(_examples, "good int, x array<double>").toArrow()
    good = table.column("good").to_numpy().astype(float)
    if not len(good) or good.min() == good.max():
        return None
    x = np.concatenate([c.flatten().to_numpy() for c in table.column("x").chunks if len(c)]).reshape(len(good), -1)
    return Classifier(x, good)


def _logit(p: Column) -> Column:
    held = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(held / (1 - held))


def _strength(groups: DataFrame, within: float) -> float:
    """Documents that the prior counts as: the variance within groups against that between their means.

    The variance between is what is left of the means' squared distances from the prior mean, weighed by
    size, beyond what the variance within explains.
    """
    n, seen, spread = groups.agg(
        F.sum("n"), F.count("*"), F.sum(F.col("n") * (F.col("mean") - F.col("prior")) ** 2)
    ).first()
    if not n or seen < 2:
        return 1e6
    between = max((spread - seen * within) / n, within * 1e-6, 1e-9)
    return min(max(within / between, 1.0), 1e6)


def judge_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE, carry: tuple[str, ...] = (), work: Work | None = None) -> DataFrame:
    """Posterior quality of every document, from its own text and from where it comes.

    A classifier on the shape of the whole text gives each document's evidence. The mean evidence of a source is
    shrunk toward that of all documents, and the mean of a part of a source (its documents of one language) toward
    its source's, each by as many documents as the variances within and between groups say. The
    part's posterior then takes the place of the global rate as the document's prior odds, to which a text of a
    few words adds only a part of its evidence. Sparse sites so take their parent's rate, and no single
    site can overrule clear evidence.

    Only sums per source and part are shuffled; a hot source is combined before. Null sources and languages
    are groups of their own. A text without words has evidence 0 and is rejected, null and empty ones too.
    Without labels of both kinds there is nothing to judge by: evidence is 1 for texts with words and
    without, and all are kept. Null and repeated ids are documents like others; an empty table gives no rows.
    Returns the ``OUTPUT`` columns and those in ``carry`` that are not named like one of them.
    """
    spark = docs.sparkSession
    work = work or Work(spark)
    evidence = _evidence(spark.sparkContext.broadcast(fit(docs, labels, sample)))
    judged = work.store(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", carried(docs, carry, OUTPUT).alias("carried"), evidence("text").alias("judged"),
    ).withColumns({"evidence": F.col("judged.evidence"), "words": F.col("judged.words")}).drop("judged"))
    p = F.col("evidence")
    parts = work.store(judged.groupBy("source", "lang").agg(F.sum(p).alias("sum"), F.sum(p * p).alias("squares"), F.count("*").alias("n")))
    total = parts.agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.sum(F.col("squares") - F.col("sum") ** 2 / F.col("n")).alias("within")).first()
    mean = (total["sum"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    within = max(total["within"] / total["n"], 1e-9) if total["n"] else 1.0

    sites = parts.groupBy("source").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).withColumn("mean", F.col("sum") / F.col("n"))
    sites = sites.withColumn("prior", F.lit(mean))
    like = _strength(sites, within)
    sites = sites.select("source", ((F.col("sum") + like * mean) / (F.col("n") + like)).alias("site_quality"))
    site = F.col("s.source")
    parts = (
        parts.alias("p").join(sites.alias("s"), F.col("p.source").eqNullSafe(site))
        .select("p.*", "s.site_quality").withColumn("mean", F.col("sum") / F.col("n")).withColumn("prior", F.col("site_quality"))
    )
    like = _strength(parts, within)
    rates = work.store(parts.select(
        F.col("source").alias("of_source"), F.col("lang").alias("of_lang"), "site_quality",
        ((F.col("sum") + like * F.col("prior")) / (F.col("n") + like)).alias("path_quality"),
    ))
    said = F.col("words") / (F.col("words") + FEW)
    odds = said * (_logit(p) - _logit(F.lit(mean))) + _logit(F.col("path_quality"))
    quality = F.when(p <= 0, 0.0).otherwise(1 / (1 + F.exp(-odds)))
    return (
        judged.join(small(rates), F.col("source").eqNullSafe(F.col("of_source")) & F.col("lang").eqNullSafe(F.col("of_lang")))
        .withColumn("quality", quality)
        .select("doc_id", "source", "lang", "evidence", "site_quality", "path_quality", "quality", (F.col("quality") >= keep).alias("kept"), *unpacked(carry, OUTPUT))
    )
