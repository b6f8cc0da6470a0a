"""Languages of words and documents by a linear-chain conditional random field."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.support import carried, unpacked
from forecourt.llm.words import NO_LETTER, mixed, portions, word_hashes, word_spans

#: Features of a word's characters, and words of the lexicon, are hashed to so many bits.
BITS, LEXICON_BITS = 16, 17
#: The field is fitted on at most so many documents in all (and at least ``LEAST`` of each language that has them), of
#: each at most so many runs of so many words, spread over the whole text.
SAMPLE, LEAST, RUNS, RUN = 1000, 40, 6, 24
STEPS, RATE, RIDGE = 40, 0.15, 1e-6
#: A document's words are passed in blocks of so many.
BLOCK = 32
UNKNOWN = "und"

_FIRST, _LAST = 1, 2  # bytes that no letter has, before and after a word
OUTPUT = ("doc_id", "lang_pred", "score", "spans")
SPANS = "array<struct<first:bigint, words:bigint, lang:string>>"


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, bounds): hashed affixes and n-grams of the words at these places; word i has those from bounds[i] on.

    Pairs and triples of bytes with marks at both ends, and four bytes at each end.
    """
    lengths = ends - starts + 2
    first = np.cumsum(lengths) - lengths
    n = int(lengths.sum())
    word = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - first[word]
    left = lengths[word] - place
    at = np.clip(starts[word] + place - 1, 0, max(len(data) - 1, 0))
    letters = np.where(place == 0, _FIRST, np.where(left == 1, _LAST, data[at] if len(data) else 0)).astype(np.uint64)
    gram, out = letters, np.empty((n, 3), np.uint64)
    fits = np.empty((n, 3), bool)
    for i, size in enumerate((2, 3, 4)):
        gram = (gram << np.uint64(8)) | np.append(letters, np.zeros(4, np.uint64))[size - 1 : size - 1 + n]
        out[:, i] = mixed(gram + np.uint64(size << 56))
        fits[:, i] = left >= size
    fits[:, 2] &= (place == 0) | (left == 4)
    bounds = np.concatenate([[0], np.cumsum(fits.sum(axis=1))])[np.append(first, n)]
    return (out[fits] >> np.uint64(64 - BITS)).astype(np.int64), bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows in each span of ``bounds``; no span is empty."""
    return np.add.reduceat(values, bounds[:-1], axis=0) if len(bounds) > 1 else np.zeros((0, values.shape[1]), values.dtype)


def _normed(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(rows.sum(axis=-1, keepdims=True), 1e-30)


@dataclass
class Field:
    """A fitted field: weights of hashed features, of the lexicon and of each language, and transitions between words."""

    langs: list[str]
    lexicon: np.ndarray  # log of each language's share among the words of a bucket
    weight: np.ndarray
    lexical: np.ndarray
    bias: np.ndarray
    step: np.ndarray

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """What each word says for each language, on its own."""
        found, bounds = features(data, starts, ends)
        bucket = (hashes >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
        return _sums(self.weight[found], bounds) + self.lexical * self.lexicon[bucket] + self.bias

    def marginals(self, said: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Forward-backward: chances of each word's languages given all words of its text.

        ``said`` are the emissions of all words, text i has those from ``firsts[i]`` on. Each text's chain is cut
        into blocks, all of which advance together; the messages between them come from products of whole blocks.
        """
        k, counts = len(self.langs), np.diff(firsts)
        per_text = -(-counts // BLOCK)
        blocks = int(per_text.sum())
        if not blocks:
            return np.zeros((0, k))
        text = np.repeat(np.arange(len(counts)), per_text)
        at = np.arange(blocks) - (np.cumsum(per_text) - per_text)[text]
        place = firsts[text][:, None] + at[:, None] * BLOCK + np.arange(BLOCK)
        real = place < firsts[text + 1][:, None]
        factor = np.exp(said - said.max(axis=1, keepdims=True))
        factor = np.where(real[:, :, None], factor[np.minimum(place, len(said) - 1)], 1.0)
        step = np.exp(self.step)
        opens = at == 0  # the first word of a text is reached from nowhere

        def forward(message: np.ndarray, i: int) -> np.ndarray:
            moved = message @ step
            if i == 0:
                moved = np.where(opens.reshape(-1, *[1] * (message.ndim - 1)), message, moved)
            here = factor[:, i] if message.ndim == 2 else factor[:, i, None]
            mask = real[:, i].reshape(-1, *[1] * (message.ndim - 1))
            moved = np.where(mask, moved * here, message)
            return moved / np.maximum(moved.max(axis=tuple(range(1, message.ndim)), keepdims=True), 1e-30)

        whole = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
        for i in range(BLOCK):
            whole = forward(whole, i)
        # Messages into each block: block after block, all texts at once, those of more blocks first.
        order = np.argsort(-per_text, kind="stable")
        start = (np.cumsum(per_text) - per_text)[order]
        longest = int(per_text.max())
        longer = np.searchsorted(-per_text[order], -np.arange(longest), side="left")  # texts of more blocks than this
        into, back = np.full((blocks, k), 1.0 / k), np.full((blocks, k), 1.0)
        for b in range(longest - 1):
            now = start[: longer[b + 1]] + b
            into[now + 1] = _normed(np.matmul(into[now][:, None], whole[now])[:, 0])
        for b in range(longest - 1, 0, -1):
            now = start[: longer[b]] + b
            back[now - 1] = _normed(np.matmul(whole[now], back[now][:, :, None])[:, :, 0])
        ahead = np.empty((blocks, BLOCK, k))
        message = into
        for i in range(BLOCK):
            message = ahead[:, i] = forward(message, i)
        message = back
        for i in range(BLOCK - 1, -1, -1):
            ahead[:, i] = _normed(ahead[:, i] * message)
            before = (message * factor[:, i]) @ step.T
            message = _normed(np.where(real[:, i, None], before, message))
        return ahead[real]


def _sequence_marginals(said: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chances of each word's languages, expected transitions) of sequences of equal length."""
    n, length, k = said.shape
    factor, move = np.exp(said - said.max(axis=2, keepdims=True)), np.exp(step)
    ahead, back = np.empty_like(factor), np.ones_like(factor)
    ahead[:, 0] = _normed(factor[:, 0])
    for i in range(1, length):
        ahead[:, i] = _normed((ahead[:, i - 1] @ move) * factor[:, i])
    for i in range(length - 1, 0, -1):
        back[:, i - 1] = _normed((back[:, i] * factor[:, i]) @ move.T)
    pairs = np.zeros((k, k))
    for i in range(1, length):
        joint = ahead[:, i - 1, :, None] * move * (factor[:, i] * back[:, i])[:, None, :]
        pairs += (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-30)).sum(axis=0)
    return _normed(ahead * back), pairs


def fit_field(langs: list[str], lexicon: np.ndarray, labels: np.ndarray, runs: list[bytes], seed: int = 5) -> Field:
    """The field of highest likelihood for runs of words of one language each, joined in pairs so that it learns to change.

    The languages are those of whole documents, which may hold words of others: after half of the steps a word that
    the field surely finds in another language than its document's takes that one.
    """
    k = len(langs)
    data = np.frombuffer(b" ".join(runs), dtype=np.uint8)
    lengths = np.array([len(r) for r in runs], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    offsets[-1] -= 1
    hashes, firsts = word_hashes(data, offsets, NO_LETTER)
    starts, ends, _ = word_spans(data, offsets, NO_LETTER)
    _, one, kind = np.unique(hashes, return_index=True, return_inverse=True)
    found, bounds = features(data, starts[one], ends[one])
    lexical = lexicon[(hashes[one] >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)]
    # Sequences of two runs of RUN words; shorter runs, as short texts give, are joined end to end before.
    label = np.repeat(labels, np.diff(firsts))
    whole = len(kind) // RUN
    at = np.random.default_rng(seed).permutation(whole)[: whole // 2 * 2] if whole > 1 else np.zeros(0, np.int64)
    if not len(at):
        at, length = np.zeros(1, np.int64), len(kind)
        index = np.arange(length)[None]
    else:
        index = (at[:, None] * RUN + np.arange(RUN)).reshape(-1, 2 * RUN)
    words, truth = kind[index], label[index]
    field = Field(langs, lexicon, np.zeros((2**BITS, k)), np.ones(k), np.zeros(k), np.zeros((k, k)))
    parameters = [field.weight, field.lexical, field.bias, field.step]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    n = words.size
    for step in range(1, STEPS + 1):
        each = _sums(field.weight[found], bounds) + field.lexical * lexical + field.bias
        chance, pairs = _sequence_marginals(each[words], field.step)
        if step == STEPS // 2:
            other = chance.argmax(axis=2)
            truth = np.where(np.take_along_axis(chance, other[..., None], 2)[..., 0] >= 0.95, other, truth)
        wrong = chance
        np.put_along_axis(wrong, truth[..., None], np.take_along_axis(wrong, truth[..., None], 2) - 1, 2)
        by_kind = np.stack([np.bincount(words.ravel(), wrong[..., c].ravel(), len(one)) for c in range(k)], axis=1)
        spread = np.repeat(by_kind, np.diff(bounds), axis=0)
        seen = np.bincount((truth[:, :-1] * k + truth[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
        slopes = [
            np.stack([np.bincount(found, spread[:, c], 2**BITS) for c in range(k)], axis=1) / n + RIDGE * field.weight,
            (by_kind * lexical).sum(axis=0) / n, by_kind.sum(axis=0) / n, (pairs - seen) / n + RIDGE * field.step,
        ]
        for p, (mean, square), slope in zip(parameters, moments, slopes, strict=True):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            p -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    field.weight = field.weight.astype(np.float32)
    return field


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in each bucket of the lexicon by language; one row each per task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            held = counts.setdefault(lang, np.zeros(2**LEXICON_BITS, dtype=np.int64))
            for _, _, data, offsets in portions(_lowered(batch.column("text").filter(pc.equal(batch.column("lang"), lang)))):
                held += np.bincount((word_hashes(data, offsets, NO_LETTER)[0] >> np.uint64(64 - LEXICON_BITS)).astype(np.int64), minlength=2**LEXICON_BITS)
    for lang, held in counts.items():
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(held[some])], names=["lang", "bucket", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to ``RUNS`` runs of ``RUN`` words of each text, spread over all of it; one of all words of a shorter text."""
    for batch in batches:
        langs, runs = [], []
        texts = _lowered(batch.column("text"))
        for first, _, data, offsets in portions(texts):
            starts, ends, firsts = word_spans(data, offsets, NO_LETTER)
            for i in range(len(offsets) - 1):
                n = int(firsts[i + 1] - firsts[i])
                some = min(RUNS, max(n // RUN, min(n, 1)))
                for at in np.arange(some) * max(n - RUN, 0) // max(some - 1, 1):
                    a = firsts[i] + at
                    langs.append(batch.column("lang")[first + i].as_py())
                    runs.append(b" ".join(data[s:e].tobytes() for s, e in zip(starts[a : min(a + RUN, firsts[i + 1])], ends[a : min(a + RUN, firsts[i + 1])], strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(runs, pa.binary())], names=["lang", "run"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field learned from documents with a language, or None without any of some words.

    The lexicon counts the words of all of them, in ``2 ** LEXICON_BITS`` buckets, so its size is that of the
    languages. The field itself is fitted on at most ``sample`` documents in all, or ``LEAST`` of each language if that is more,
    chosen by a hash.
    """
    known = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(sizes)
    if not langs:
        return None
    table = known.mapInArrow(_word_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2**LEXICON_BITS, len(langs)))
    number = {lang: i for i, lang in enumerate(langs)}
    column = lambda t, c: t.column(c).to_pylist()
    counts[table.column("bucket").to_numpy(), [number[x] for x in column(table, "lang")]] = table.column("n").to_numpy()
    share = counts / np.maximum(counts.sum(axis=0), 1)
    # A word's share in each language, with as much added as if it had been seen twice in an average one.
    share += 2 / max(counts.sum(), 1) * len(langs)
    lexicon = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    most = max(sample // len(langs), LEAST)
    drawn = F.xxhash64("doc_id", F.lit("languages"))
    odds = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(2.0 * (most + 10) / sizes[lang], 1.0)))])
    likely = known.withColumn("drawn", drawn).filter(F.pmod("drawn", F.lit(1 << 30)) < odds[F.col("lang")] * (1 << 30))
    order = Window.partitionBy("lang").orderBy("drawn", "doc_id", F.xxhash64("text"))
    chosen = likely.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    runs = chosen.select("lang", "text").mapInArrow(_runs, "lang string, run binary").orderBy("lang", "run").toArrow()
    if not len(runs):
        return None
    return fit_field(langs, lexicon, np.array([number[x] for x in column(runs, "lang")]), column(runs, "run"))


def _identify(shared, with_spans: bool):
    """(language, score, spans) of each text."""

    def identify(texts: pa.Array) -> pa.Array:
        field = shared.value
        langs, scores, spans = [], [], []
        for first, end, data, offsets in portions(_lowered(texts)):
            hashes, firsts = word_hashes(data, offsets, NO_LETTER)
            starts, ends, _ = word_spans(data, offsets, NO_LETTER)
            _, one, kind = np.unique(hashes, return_index=True, return_inverse=True)
            chance = field.marginals(field.emissions(data, starts[one], ends[one], hashes[one])[kind], firsts)
            counts = np.diff(firsts)
            before = np.concatenate([np.zeros((1, chance.shape[1])), np.cumsum(chance, axis=0)])
            mean = (before[firsts[1:]] - before[firsts[:-1]]) / np.maximum(counts, 1)[:, None]
            best = mean.argmax(axis=1)
            langs += [field.langs[b] if n else UNKNOWN for b, n in zip(best, counts, strict=True)]
            scores.append(np.clip(mean[np.arange(len(best)), best], 0, 1))
            if with_spans:
                spans += _language_spans(field.langs, chance.argmax(axis=1), firsts)
            else:
                spans += [None] * (end - first)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores])), pa.array(spans, kind)], names=["lang_pred", "score", "spans"]
        )

    return F.arrow_udf(identify, f"lang_pred string, score double, spans {SPANS}")


def _language_spans(langs: list[str], label: np.ndarray, firsts: np.ndarray) -> list[list[dict]]:
    """Of each text its runs of words of one language."""
    opens = np.ones(len(label), dtype=bool)
    opens[1:] = label[1:] != label[:-1]
    opens[firsts[:-1][firsts[:-1] < len(label)]] = True
    at = np.flatnonzero(opens)
    ends = np.append(at[1:], len(label))
    cut = np.searchsorted(at, firsts)
    return [
        [{"first": int(a - firsts[i]), "words": int(e - a), "lang": langs[label[a]]} for a, e in zip(at[cut[i] : cut[i + 1]], ends[cut[i] : cut[i + 1]], strict=True)]
        for i in range(len(firsts) - 1)
    ]


def identify_languages(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, spans: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The language of every document, and on request of every run of its words.

    A conditional random field labels the words (runs of letters) of a whole text: hashed affixes and n-grams of the
    word and its place in a lexicon of all labelled documents speak for each language, and learned transitions join
    neighbours. Forward-backward gives each word's chances given the whole text; the document's language is
    the one of the highest mean chance, its score (ties: the first in order of code points). ``spans`` lists
    the runs of words of one language, by words from 0.

    Learns from ``labelled`` (doc_id, text, lang) alone; null languages and texts there teach nothing. A text that is
    null or has no letter is ``und`` with score 0 and no spans, and so is every text if nothing was learned. Null and
    repeated ids are documents like others; an empty table gives no rows. A portion of about 4 MB of text is
    labelled at a time, a longer text alone. Returns the ``OUTPUT`` columns (spans on request) and those in ``carry`` that are not named like one of them.
    """
    field = fit(labelled, sample)
    kept = [*OUTPUT[:3], *(["spans"] if spans else [])]
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", carried(docs, carry, OUTPUT).alias("carried"))
    lettered = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    none = F.lit(None).cast(f"struct<lang_pred:string, score:double, spans:{SPANS}>")
    said: Column = none if field is None else _identify(docs.sparkSession.sparkContext.broadcast(field), spans)(F.when(lettered, F.col("text")))
    told = told.withColumn("said", said)
    values = {
        "doc_id": F.col("doc_id"), "lang_pred": F.when(lettered & F.col("said").isNotNull(), F.col("said.lang_pred")).otherwise(UNKNOWN),
        "score": F.when(lettered & F.col("said").isNotNull(), F.col("said.score")).otherwise(0.0),
        "spans": F.when(lettered, F.col("said.spans")),
    }
    return told.select(*[values[c].alias(c) for c in kept], *unpacked(carry, OUTPUT))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Languages of all documents, learned from those whose checksum of the id mod 4 is not 2; a null id is not held out and teaches nothing."""
    out = held_out(F.col("doc_id"))
    taught = docs.filter(F.col("doc_id").isNotNull() & ~out)
    return identify_languages(docs, taught).select("doc_id", out.alias("held_out"), "lang_pred", "score")
