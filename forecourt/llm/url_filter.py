"""URL filter: rules first, then the ratio of two character language models, learned from what the rules judge."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.support import Work
from forecourt.llm.words import portions

#: (verdict, host, path): a rule fits its host and all subdomains, and paths that start with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Symbols of the models: these characters, one for all other bytes, one for what stands before the start.
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&#%:~+"
SYMBOLS = len(CHARACTERS) + 2
#: Longest context. A model has SYMBOLS ** (ORDER + 1) figures, however large the data are.
ORDER = 3
FOLDS = 5  # one in so many of the judged URLs calibrates, the others train
_SPAN, _STEPS = 8.0, 1600  # of the score's histogram

_SYMBOL = np.full(256, SYMBOLS - 2, dtype=np.int64)
for _i, _c in enumerate(CHARACTERS):
    _SYMBOL[ord(_c)] = _SYMBOL[ord(_c.upper())] = _i


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, all after ``://``) of a URL; empty without ``://`` and for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), rest


def _longest_rule(rules) -> tuple[Column, Column]:
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, the number of the ORDER symbols before it and itself."""
    now = _SYMBOL[data]
    begins = np.repeat(offsets[:-1], np.diff(offsets))
    code = now.copy()
    at = np.arange(len(data))
    for back in range(1, ORDER + 1):
        before = np.full(len(data), SYMBOLS - 1)
        before[back:] = now[:-back] if back < len(now) else now[:0]
        before[at - back < begins] = SYMBOLS - 1
        code += before * SYMBOLS**back
    return code


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = np.array([v == "allow" for v in batch.column("judged").to_pylist()], dtype=bool)
        for first, end, data, offsets in portions(batch.column("rest")):
            of = np.repeat(good[first:end], np.diff(offsets))
            codes, place = np.unique(_codes(data, offsets), return_inverse=True)
            n = [np.bincount(place[of == kind], minlength=len(codes)) for kind in (True, False)]
            yield pa.RecordBatch.from_arrays([pa.array(codes), *map(pa.array, n)], names=["code", "allowed", "blocked"])


def conditional_logs(counts: np.ndarray) -> np.ndarray:
    """Log probability of each symbol after each context, orders interpolated by Witten and Bell's weights.

    A context counts as often as it was seen; the number of different symbols seen after it is what goes to the
    next shorter context, and the shortest one shares with equal chances.
    """
    chance = np.full((1, SYMBOLS), 1 / SYMBOLS)
    for order in range(ORDER + 1):
        n = counts.reshape(-1, SYMBOLS**order, SYMBOLS).sum(axis=0)
        kinds = (n > 0).sum(axis=1, keepdims=True)
        total = n.sum(axis=1, keepdims=True)
        shorter = np.tile(chance, (n.shape[0] // chance.shape[0], 1))
        chance = np.where(total > 0, (n + kinds * shorter) / np.maximum(total + kinds, 1), shorter)
    return np.log(chance).ravel()


def fit(work: Work, judged: DataFrame) -> np.ndarray:
    """Difference of the two models' log probabilities, by code. All URLs that rules judged are counted."""
    counted = work.store(
        judged.mapInArrow(_count, "code long, allowed long, blocked long").groupBy("code").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    )
    table = counted.toPandas()  # at most SYMBOLS ** (ORDER + 1) rows
    logs = []
    for kind in ("allowed", "blocked"):
        counts = np.zeros(SYMBOLS ** (ORDER + 1))
        counts[table["code"].to_numpy()] = table[kind].to_numpy()
        if not counts.any():
            return np.zeros(len(counts), dtype=np.float32)
        logs.append(conditional_logs(counts))
    return (logs[0] - logs[1]).astype(np.float32)


def _scores(table):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in portions(batch.column("rest")):
                sums = np.concatenate([[0.0], np.cumsum(table.value[_codes(data, offsets)], dtype=np.float64)])
                length = np.diff(offsets)
                mean = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(length, 1)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(mean)], names=[*batch.schema.names, "score"])

    return score


def _cut(bins) -> float:
    """The score with the least sum of the two error rates, the one nearest 0 among equals."""
    counts = np.zeros((2, _STEPS + 1))
    for row in bins:
        counts[int(row["judged"] == "allow"), row["bin"]] += row["n"]
    if not counts.sum(axis=1).all():
        return 0.0
    blocked, allowed = counts / counts.sum(axis=1, keepdims=True)
    below = np.concatenate([[0], np.cumsum(allowed)])
    above = 1 - np.concatenate([[0], np.cumsum(blocked)])
    error = np.round(below + above, 12)
    edges = np.arange(_STEPS + 2) * (2 * _SPAN / _STEPS) - _SPAN
    best = np.flatnonzero(error == error.min())
    return float(edges[best[np.argmin(abs(edges[best]))]])


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Judge every URL: page_id, host, path, rule, verdict, score, threshold.

    The longest rule that fits decides. URLs that rules judge are the models' examples of accepted and
    rejected ones; the models see the lower-cased URL after ``://``, byte by byte. An URL without a rule is
    allowed if its mean log-likelihood difference reaches the threshold, which a held-out fold of the judged
    URLs calibrates. Folds go by the URL, so that repeated URLs lie in one fold.

    A null URL or one without ``://`` has an empty host and path, no rule, and score 0; it is allowed, as
    nothing speaks against it. Without examples of both kinds every score is 0 and all are allowed. Ids are
    handed through, null and repeated ones too; an empty table gives no rows.
    """
    spark = pages.sparkSession
    work = Work(spark)
    host, path, rest = parts(F.col("url"))
    split = pages.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"), rest.alias("rest"))
    rule, judged = _longest_rule(rules)
    urls = work.store(
        split.withColumn("rule", rule).withColumn("judged", judged).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS))).drop("url")
    )
    known = urls.filter("judged IS NOT NULL").select("rest", "judged", "fold")
    table = spark.sparkContext.broadcast(fit(work, known.filter("fold > 0").select("rest", "judged")))
    score = _scores(table)
    held = known.filter("fold = 0").select("rest", "judged").mapInArrow(score, "rest string, judged string, score double")
    clipped = F.greatest(F.least(F.col("score"), F.lit(_SPAN)), F.lit(-_SPAN))
    bins = held.groupBy("judged", F.floor((clipped + _SPAN) * (_STEPS / (2 * _SPAN))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    cut = _cut(bins.collect())  # at most two rows for each bin
    scored = urls.select("page_id", "host", "path", "rule", "judged", "rest").mapInArrow(
        score, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, judged string, rest string, score double"
    )
    learned = F.when((F.col("rest") == "") | (F.col("score") >= cut), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("judged", learned).alias("verdict"), "score", F.lit(cut).alias("threshold"))
