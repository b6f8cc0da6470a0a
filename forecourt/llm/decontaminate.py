"""Benchmark decontamination: latent semantic candidates and those with an item's rarest words, confirmed by common
subsequences and answers."""

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.support import Work
from forecourt.llm.words import NO_WORD, mixed, split_portions, word_hashes

#: Passages are windows of so many words, each beginning half a window after the one before.
WINDOW = 64
STRIDE = WINDOW // 2
#: Terms are hashed to so many bits to count them; a benchmark's own terms are told apart exactly.
BITS = 17
#: Directions of the latent space: an eighth of a block's passages within these bounds, and so many columns more in the sketch.
LEAST_RANK, MOST_RANK, OVERSAMPLE = 64, 256, 16
#: A passage is a latent candidate for the items of at least this cosine.
COSINE = 0.55
#: A candidate is a leak if the common subsequence of words has this share of the item's words, or
#: the lower share while the item's answer, its last sentence of at least so many words, follows word by word.
SUBSEQUENCE, WITH_ANSWER, ANSWER_WORDS = 0.75, 0.5, 4
#: The subsequence lies within so many times the item's words.
SPAN = 1.5
#: A latent candidate is a leak, in any order of words, with this share of the item's rarity, or the
#: lower share with the rarer words of its answer.
ANY_ORDER, ANY_ORDER_WITH_ANSWER = 0.85, 0.6
#: Gaps and other orders are looked for in passages of so many words or more.
LEAST_LOOSE = 8
#: A test is made only if less than exp(-3) places in all documents should pass it by chance.
CHANCE = 3.0
#: Words of items that are searched for at once, about; more are taken in further blocks.
BLOCK_WORDS = 200_000
#: Meetings of a text's words with passages that are counted at once, about.
MEETINGS = 4_000_000

_HITS = "array<struct<item_id:bigint, share:double, cosine:double, answered:boolean, found:string>>"


class Benchmark:
    """The passages of a block of items: words, terms, and what a window of a text must hold to be compared with each.

    Of a passage of n words a subsequence misses a quarter at most, so of its rarest n / 4 + k words it has k. And of an
    answer that follows word by word it has the first ``ANSWER_WORDS``. What keeps the order of words is found by one of
    these; what does not, by its latent cosine.

    ``rarity`` is minus the log of each hashed term's share of ``total`` words. If words came independently, exp of minus its sum over
    some words would be the chance of these at one place, so a test is made of a passage only if
    its words are rare enough that hardly any place in all documents passes by chance. ``loose`` tells where the subsequence
    may have gaps, ``strict`` where all words must follow one another; a passage with neither cannot be tested.
    """

    def __init__(
        self, ids: list[int | None], words: np.ndarray, firsts: np.ndarray, answers: list[tuple[int, ...]], idf: np.ndarray,
        rarity: np.ndarray | None = None, total: int = 1,
    ):
        self.ids, self.words, self.firsts, self.answers = ids, words, firsts, answers
        self.terms, self.term = np.unique(words, return_inverse=True)
        self.known = np.zeros(2**BITS, dtype=bool)
        self.known[self.terms >> np.uint64(64 - BITS)] = True
        n = np.diff(firsts)
        of = np.repeat(np.arange(len(n)), n)
        self.weight = idf[words >> np.uint64(64 - BITS)]
        self.weight = (self.weight / np.sqrt(np.bincount(of, self.weight.astype(float) ** 2, len(n)))[of]).astype(np.float32)
        self.needed = np.maximum(n // 8, 1)
        most = (n * (1 - SUBSEQUENCE) + 1e-9).astype(np.int64) + self.needed
        rarest = np.lexsort((words, -self.weight, of))
        rarest = rarest[np.arange(len(words)) - firsts[of] < most[of]]
        posted = np.unique(self.term[rarest].astype(np.int64) * len(n) + of[rarest])
        self.posted = posted % len(n)
        self.post_firsts = np.searchsorted(posted, np.arange(len(self.terms) + 1) * len(n))
        with_answer = [i for i, answer in enumerate(answers) if answer]
        grams = _grams(np.array([w for i in with_answer for w in answers[i][:ANSWER_WORDS]], dtype=np.uint64))[::ANSWER_WORDS]
        order = np.argsort(grams, kind="stable")
        self.grams, self.gram_passage = grams[order], np.array(with_answer, dtype=np.int64)[order]
        self.gram_known = np.zeros(2**BITS, dtype=bool)
        self.gram_known[grams >> np.uint64(64 - BITS)] = True
        self.masks: dict[int, dict[int, int]] = {}
        self.places = math.log(max(total, 1)) + CHANCE
        rarity = np.full(2**BITS, 50.0) if rarity is None else rarity
        self.rare = rarity[words >> np.uint64(64 - BITS)]
        self.loose, self.strict = _testable(self.rare, firsts, self.places)
        # The words of an answer that tell it from others: those rarer than a third of what a place needs.
        rare = lambda answer: [float(rarity[w >> (64 - BITS)]) for w in answer]
        self.telling = [Counter(w for w, r in zip(a, rare(a), strict=True) if r >= self.places / 3) for a in answers]
        self.answer_tells = [sum(rare(a)) >= 1.5 * self.places for a in answers]

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 for words that no item has."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        maybe = np.flatnonzero(self.known[hashes >> np.uint64(64 - BITS)])
        at = np.searchsorted(self.terms, hashes[maybe])
        at[at == len(self.terms)] = 0
        same = self.terms[at] == hashes[maybe] if len(self.terms) else np.zeros(0, bool)
        out[maybe[same]] = at[same]
        return out

    def weighed(self, rows: np.ndarray) -> np.ndarray:
        """The passages' TF-IDF rows, of length one, times ``rows``."""
        return _weighed_sums(rows, self.term, self.weight, self.firsts)

    def spread(self, rows: np.ndarray) -> np.ndarray:
        """Transpose of the passages' TF-IDF rows times ``rows``."""
        order = np.argsort(self.term, kind="stable")
        of = np.repeat(np.arange(len(self.ids)), np.diff(self.firsts))
        return _weighed_sums(rows, of[order], self.weight[order], np.searchsorted(self.term[order], np.arange(len(self.terms) + 1)))

    def common(self, passage: int, words: list[int]) -> float:
        """Share of the passage's words in its longest common subsequence with ``words``."""
        own = self.words[self.firsts[passage] : self.firsts[passage + 1]].tolist()
        mask = self.masks.get(passage)
        if mask is None:
            mask = self.masks[passage] = defaultdict(int)
            for i, w in enumerate(own):
                mask[w] |= 1 << i
        n = len(own)
        full = (1 << n) - 1
        free = full
        for w in words:
            if w in mask:
                hit = free & mask[w]
                free = ((free + hit) | (free - hit)) & full
        return 1 - free.bit_count() / n

    def common_within(self, passage: int, words: list[int]) -> float:
        """``common`` of the best run of ``words`` that is at most ``SPAN`` times as long as the passage."""
        span = math.ceil(SPAN * (self.firsts[passage + 1] - self.firsts[passage]))
        best = self.common(passage, words)
        if len(words) <= span or best < WITH_ANSWER:
            return best if len(words) <= span else 0.0
        mask, most = self.masks[passage], 0.0
        for start, word in enumerate(words):
            if word in mask:
                most = max(most, self.common(passage, words[start : start + span]))
                if most >= best:
                    break
        return most

    def answered(self, passage: int, words: list[int]) -> bool:
        return _follows(self.answers[passage], words)

    def any_order(self, passage: int, words: list[int]) -> tuple[float, bool]:
        """(share of the passage's rarity among ``words`` in any order, or 0 if that may be chance; whether
        the words that tell its answer are all among them)."""
        at = slice(self.firsts[passage], self.firsts[passage + 1])
        held = Counter(words)
        found = surprise = 0.0
        for word, rare in zip(self.words[at].tolist(), self.rare[at].tolist(), strict=True):
            if held[word] > 0:
                held[word] -= 1
                found += rare
                surprise += max(rare - math.log(len(words)), 0.0)
        telling = self.telling[passage]
        share = found / max(float(self.rare[at].sum()), 1e-9)
        return (share if surprise >= self.places else 0.0), bool(telling) and telling <= Counter(words)

    def judged(self, passage: int, words: list[int], cosine: float) -> tuple[float, bool, str] | None:
        """(share, answered, how it was found) if these words, of a window and half a window to each side, hold the passage."""
        share, answered = 0.0, self.answered(passage, words)
        if self.loose[passage]:
            share = self.common_within(passage, words)
            if share >= SUBSEQUENCE:
                return share, answered, "subsequence"
        elif self.strict[passage] and _follows(tuple(self.words[self.firsts[passage] : self.firsts[passage + 1]].tolist()), words):
            return 1.0, answered, "word by word"
        if answered and self.answer_tells[passage]:
            share = share or self.common_within(passage, words)
            if share >= WITH_ANSWER:
                return share, True, "answer"
        if cosine >= COSINE and self.loose[passage]:
            # Near by: within twice the passage's words, each such run that begins with one of them.
            span = 2 * int(self.firsts[passage + 1] - self.firsts[passage])
            own = self.masks[passage]
            if self.enough(*self.any_order(passage, words)) and any(
                self.enough(*self.any_order(passage, words[i : i + span])) for i, w in enumerate(words) if w in own
            ):
                return share, answered, "latent"
        return None

    @staticmethod
    def enough(among: float, told: bool) -> bool:
        return among >= ANY_ORDER or (told and among >= ANY_ORDER_WITH_ANSWER)


def _follows(part: tuple[int, ...], words: list[int]) -> bool:
    """Whether the words of ``part`` follow one another among ``words``."""
    return bool(part) and any(tuple(words[i : i + len(part)]) == part for i, w in enumerate(words) if w == part[0])


def _testable(rare: np.ndarray, firsts: np.ndarray, places: float) -> tuple[np.ndarray, np.ndarray]:
    """(loose, strict) of each passage.

    With gaps, the most common three quarters of n words may be the ones found, in one of C(n, 3n/4) choices and
    C(1.5n, 3n/4) places of the span; their logs are under 0.57 n and 1.04 n. Words of a language do not come
    independently, so words that follow one another must be rarer by half than that takes.
    """
    loose, strict = np.zeros(len(firsts) - 1, dtype=bool), np.zeros(len(firsts) - 1, dtype=bool)
    for i in range(len(firsts) - 1):
        own = np.sort(rare[firsts[i] : firsts[i + 1]])
        strict[i] = own.sum() >= 1.5 * places
        loose[i] = strict[i] and len(own) >= LEAST_LOOSE and own[: math.ceil(SUBSEQUENCE * len(own))].sum() >= places + 1.61 * len(own)
    return loose, strict


def _grams(words: np.ndarray) -> np.ndarray:
    """A hash of the ``ANSWER_WORDS`` words from each word on."""
    out = np.zeros(max(len(words) - ANSWER_WORDS + 1, 0), dtype=np.uint64)
    for i in range(ANSWER_WORDS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(out)]
    return mixed(out)


def _hashed(text: str) -> np.ndarray:
    return next((word_hashes(d, o, NO_WORD)[0] for _, _, d, o in split_portions(pa.array([text]))), np.zeros(0, np.uint64))


def _item_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of the items of each row, with the item's answer beside its last passage, and a hash of all its words."""
    for batch in batches:
        ids, wholes, numbers, passages, answers = [], [], [], [], []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = _hashed(text)
            whole = int(mixed((words * (2 * np.arange(len(words), dtype=np.uint64) + np.uint64(1))).sum(keepdims=True)).view(np.int64)[0])
            sentences = [s for s in re.split(r"[?!\n。．｡！？]|\.(?!\d)", text) if s.strip()]
            tail = _hashed(sentences[-1]) if len(sentences) > 1 else words[:0]
            for at in range(0, max(len(words) - WINDOW // 4, 1), WINDOW):
                last = at + WINDOW + WINDOW // 4 >= len(words)
                passage = words[at:] if last else words[at : at + WINDOW]
                if len(passage):
                    ids.append(item)
                    wholes.append(whole)
                    numbers.append(at)
                    passages.append(passage.view(np.int64))
                    answers.append((tail if last and len(tail) >= ANSWER_WORDS else tail[:0]).view(np.int64))
                if last:
                    break
        lists = pa.list_(pa.int64())
        columns = [pa.array(ids, pa.int64()), pa.array(wholes, pa.int64()), pa.array(numbers, pa.int64()), pa.array(passages, lists), pa.array(answers, lists)]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "whole", "at", "words", "answer"])


class Passages:
    """The words of some texts that items have, in runs of STRIDE words; two neighbouring runs are a passage.

    A passage is a TF-IDF row: each of these words adds its idf to its term.
    """

    def __init__(self, words: np.ndarray, firsts: np.ndarray, idf: np.ndarray, bench: Benchmark):
        self.words, self.firsts = words, firsts
        term = bench.index(self.words)
        counts = np.diff(self.firsts)
        runs = -(-counts // STRIDE)
        self.text = np.repeat(np.arange(len(counts)), runs)
        first = np.cumsum(runs) - runs
        self.start = self.firsts[self.text] + (np.arange(len(self.text)) - first[self.text]) * STRIDE
        self.lone = np.zeros(len(self.text), dtype=bool)  # ends its text, so that no passage begins there
        self.lone[np.cumsum(runs)[runs > 1] - 1] = True
        at = np.flatnonzero(term >= 0)
        self.term, self.weight = term[at], idf[self.words[at] >> np.uint64(64 - BITS)]
        self.bounds = np.searchsorted(at, np.append(self.start, len(self.words)))
        # For the fit, runs are paired so that no word counts twice.
        pair = first[self.text] + (np.arange(len(self.text)) - first[self.text]) // 2 * 2
        self.pair = np.repeat(pair, np.diff(self.bounds))
        length = np.add.reduceat(idf[self.words >> np.uint64(64 - BITS)] ** 2, self.start) if len(self.start) else np.zeros(0)
        self.length = np.sqrt(np.bincount(pair, length, len(pair)))

    def latent(self, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, runs): the passage that begins with each run in the directions of ``basis``, of length one or 0,
        and the runs with which a passage begins that is not 0 there."""
        each = _weighed_sums(basis, self.term, self.weight, self.bounds)
        if len(each):
            ends = np.append(self.text[1:] != self.text[:-1], True)
            each[~ends] += each[1:][~ends[:-1]]
        length = np.linalg.norm(each, axis=1)
        return each / np.maximum(length, 1e-30)[:, None], np.flatnonzero(~self.lone & (length > 0))

    def _around(self, run: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        """The runs whose windows hold each run, which begin a run before and end two after, with the run's values."""
        near = (run[:, None] + np.arange(-2, 2)).ravel()
        inside = np.clip(near, 0, len(self.text) - 1)
        fits = (near == inside) & (self.text[inside] == np.repeat(self.text[run], 4)) & ~self.lone[inside]
        return near[fits], *[np.repeat(v, 4)[fits] for v in values]

    def meetings(self, bench: Benchmark) -> np.ndarray:
        """run * passages + passage wherever a window can hold a passage: every leak is among these."""
        n, found = len(bench.ids), []
        sizes = np.diff(bench.post_firsts)[self.term]
        before = np.concatenate([[0], np.cumsum(sizes)])[self.bounds]
        first = 0
        while first < len(self.text):
            end = max(first + 1, int(np.searchsorted(before, before[first] + MEETINGS, side="right")) - 1)
            lo, hi = max(first - 1, 0), min(end + 2, len(self.text))
            at = slice(self.bounds[lo], self.bounds[hi])
            size = sizes[at]
            run = np.repeat(np.repeat(np.arange(lo, hi), np.diff(self.bounds[lo : hi + 1])), size)
            place = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
            keys, counts = np.unique(run * n + bench.posted[np.repeat(bench.post_firsts[self.term[at]], size) + place], return_counts=True)
            run, passage, counts = self._around(keys // n, keys % n, counts)
            own = (run >= first) & (run < end)
            keys, back = np.unique(run[own] * n + passage[own], return_inverse=True)
            found.append(keys[np.bincount(back, counts[own], len(keys)) >= bench.needed[keys % n]])
            first = end
        if len(bench.grams):
            grams = _grams(self.words)
            at = np.flatnonzero(bench.gram_known[grams >> np.uint64(64 - BITS)])
            low, high = (np.searchsorted(bench.grams, grams[at], side=side) for side in ("left", "right"))
            size = high - low
            run = np.repeat(np.searchsorted(self.start, at, side="right") - 1, size)
            place = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
            run, passage = self._around(run, bench.gram_passage[np.repeat(low, size) + place])
            found.append(run * n + passage)
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def gram_times(self, basis: np.ndarray) -> np.ndarray:
        """Transpose of the rows, of length one, times the rows times ``basis``."""
        weight = (self.weight / np.maximum(self.length[self.pair], 1e-9)).astype(np.float32)
        each = _weighed_sums(basis, self.term, weight, self.bounds)
        odd = np.flatnonzero((np.arange(len(self.text)) - np.searchsorted(self.text, self.text)) % 2)
        each[odd - 1] += each[odd]
        order = np.argsort(self.term, kind="stable")
        bounds = np.searchsorted(self.term[order], np.arange(len(basis) + 1))
        return _weighed_sums(each, self.pair[order], weight[order], bounds)


def _weighed_sums(rows: np.ndarray, index: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each span of ``bounds``, the sum of weight * rows[index] over it.

    Spans are cut into pieces of STRIDE, filled up with weight 0, whose sums are matrix products.
    """
    lengths = np.diff(bounds)
    pieces = -(-lengths // STRIDE)
    first = np.cumsum(pieces) - pieces
    n = int(pieces.sum())
    at = np.repeat(first * STRIDE - bounds[:-1], lengths) + np.arange(len(index))
    padded, factor = np.zeros(n * STRIDE, dtype=np.int64), np.zeros(n * STRIDE, dtype=np.float32)
    padded[at], factor[at] = index, weight
    padded, factor = padded.reshape(n, STRIDE), factor.reshape(n, 1, STRIDE)
    sums = np.empty((n, rows.shape[1]), dtype=np.float32)
    for i in range(0, n, 1024):
        sums[i : i + 1024] = np.matmul(factor[i : i + 1024], rows[padded[i : i + 1024]])[:, 0]
    out = np.zeros((len(lengths), rows.shape[1]), dtype=np.float32)
    full = np.flatnonzero(pieces)
    if len(full):
        out[full] = sums if n == len(full) else np.add.reduceat(sums, first[full], axis=0)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each hashed term, and of passages under -1; one row each per task."""
    counts, passages = np.zeros(2**BITS, dtype=np.int64), 0
    for batch in batches:
        for _, _, data, offsets in split_portions(batch.column("text")):
            words, firsts = word_hashes(data, offsets, NO_WORD)
            counts += np.bincount((words >> np.uint64(64 - BITS)).astype(np.int64), minlength=2**BITS)
            passages += int((-(-np.diff(firsts) // WINDOW)).sum())
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([[-1], some])), pa.array(np.concatenate([[passages], counts[some]]))], names=["term", "n"]
    )


def term_weights(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(idf, rarity, words): of each hashed term the idf over the passages of all documents, an occurrence counting as a passage,
    and minus the log of its share of all words; and how many words there are."""
    table = docs.select("text").mapInArrow(_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = table.column("term").to_numpy(), table.column("n").to_numpy()  # at most 2 ** BITS + 1
    total = int(n[term == -1].sum())
    counts = np.zeros(2**BITS)
    counts[term[term >= 0]] = n[term >= 0]
    words = int(counts.sum())
    idf = (np.log((total + 1) / (np.minimum(counts, total) + 1)) + 0.1).astype(np.float32)
    return idf, np.log((words + 1) / (counts + 1)).astype(np.float32), words


#: Columns of a sketch are added up so many at a time.
_COLUMNS = 16


def _sketch(shared):
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, benches, randoms = shared.value
        sums, energy = [np.zeros(r.shape) for r in randoms], [0.0] * len(benches)
        for batch in batches:
            for _, _, data, offsets in split_portions(batch.column("text")):
                hashed = word_hashes(data, offsets, NO_WORD)
                for i, (bench, random) in enumerate(zip(benches, randoms, strict=True)):
                    passages = Passages(*hashed, idf, bench)
                    sums[i] += passages.gram_times(random)
                    energy[i] += int((passages.length > 0).sum())
        for i, each in enumerate(sums):
            some = np.flatnonzero(each.any(axis=1))
            rows = np.concatenate([each[some], np.full((1, each.shape[1]), energy[i])])
            for part in range(0, each.shape[1], _COLUMNS):
                columns = [pa.array(np.ascontiguousarray(rows[:, part + c])) for c in range(_COLUMNS)]
                same = lambda value: pa.array(np.full(len(rows), value, np.int64))
                yield pa.RecordBatch.from_arrays([same(i), same(part), pa.array(np.concatenate([some, [-1]])), *columns], names=["block", "part", "term", *[f"c{c}" for c in range(_COLUMNS)]])

    return partial


def _rank(bench: Benchmark) -> int:
    """Directions of a block's latent space, which grow with what must be told apart there; a multiple of ``_COLUMNS``."""
    return min(max(-(-len(bench.ids) // 8 // _COLUMNS) * _COLUMNS, LEAST_RANK), MOST_RANK)


def latent_bases(docs: DataFrame, idf: np.ndarray, benches: list[Benchmark]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block (basis, items): right singular directions of all passages' TF-IDF rows, and the items in them.

    Randomised: a Gaussian matrix goes through the passages once, in every task, whose sums
    are added up; the eigenvectors of that sketch of the Gram matrix are the basis. The items'
    own rows count as much as all passages together. One pass over the documents serves all blocks.
    """
    generator = np.random.default_rng(11)
    randoms = [generator.normal(size=(len(b.terms), _rank(b) + OVERSAMPLE)).astype(np.float32) for b in benches]
    shared = docs.sparkSession.sparkContext.broadcast((idf, benches, randoms))
    columns = [f"c{c}" for c in range(_COLUMNS)]
    summed = docs.select("text").mapInArrow(_sketch(shared), "block long, part long, term long, " + ", ".join(f"{c} double" for c in columns))
    table = summed.groupBy("block", "part", "term").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # a row per term of the items and part
    block, part, term = (table.column(c).to_numpy() for c in ("block", "part", "term"))
    values = np.stack([table.column(c).to_numpy() for c in columns], axis=1)
    return [_basis(b, r, *[x[block == i] for x in (part, term, values)]) for i, (b, r) in enumerate(zip(benches, randoms, strict=True))]


def _basis(bench: Benchmark, random: np.ndarray, part: np.ndarray, term: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sketch = np.zeros(random.shape)
    for start in range(0, random.shape[1], _COLUMNS):
        rows = (part == start) & (term >= 0)
        sketch[term[rows], start : start + _COLUMNS] = values[rows]
    energy = values[(term == -1) & (part == 0)][:, 0].sum()
    sketch += bench.spread(bench.weighed(random)) * (max(energy, 1.0) / len(bench.ids))
    middle = random.T @ sketch
    value, vector = np.linalg.eigh((middle + middle.T) / 2)
    good = np.flatnonzero(value > value.max() * 1e-10)
    white = sketch @ (vector[:, good] / np.sqrt(value[good]))
    del sketch  # as large as what is decomposed next
    left = np.linalg.svd(white, full_matrices=False)[0]
    basis = np.ascontiguousarray(left[:, : _rank(bench)], dtype=np.float32)
    items = bench.weighed(basis)
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-12)
    return basis, items


def _search(p: "Passages", bench: Benchmark, basis: np.ndarray, items: np.ndarray, best: list[dict]) -> None:
    """Put the leaks of a block's items into ``best``, one dictionary for each text."""
    latent, runs = p.latent(basis)
    near = [p.meetings(bench)]
    for i in range(0, len(runs), 4096):
        a, b = np.nonzero(latent[runs[i : i + 4096]] @ items.T >= COSINE)
        near.append(runs[i + a] * len(items) + b)
    for run, b in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(near)), len(items))), strict=True):
        text = int(p.text[run])
        start, end = p.start[run] - STRIDE, p.start[run] + WINDOW + STRIDE
        words = p.words[max(start, p.firsts[text]) : min(end, p.firsts[text + 1])].tolist()
        cosine = float(latent[run] @ items[b])
        leak = bench.judged(b, words, cosine)
        if leak:
            share, answered, found = leak
            hit = share, cosine, answered, found
            best[text][bench.ids[b]] = max(best[text].get(bench.ids[b], hit), hit)


def _hits(shared):
    """Leaks of each text: the items whose passages it holds. Each text is split once for all blocks."""

    def find(texts: pa.Array) -> pa.Array:
        idf, blocks = shared.value
        out = []
        for first, end, data, offsets in split_portions(texts):
            best: list[dict] = [{} for _ in range(end - first)]
            hashed = word_hashes(data, offsets, NO_WORD)
            for bench, basis, items in blocks:
                _search(Passages(*hashed, idf, bench), bench, basis, items, best)
            in_order = lambda hits: sorted(hits.items(), key=lambda hit: (hit[0] is None, hit[0] or 0))
            out += [[{"item_id": k, "share": s, "cosine": c, "answered": a, "found": f} for k, (s, c, a, f) in in_order(hits)] for hits in best]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("cosine", pa.float64()), ("answered", pa.bool_()), ("found", pa.string())]))
        return pa.array(out, kind)

    return F.arrow_udf(find, _HITS)


def _blocks(docs: DataFrame, benchmark: DataFrame) -> tuple[list[Benchmark], np.ndarray | None]:
    """The benchmark's passages in blocks of about ``BLOCK_WORDS`` words, which bound what the driver holds of it at a time."""
    work = Work(docs.sparkSession)
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    passages = items.mapInArrow(_item_passages, "item_id long, whole long, at long, words array<long>, answer array<long>")
    passages = work.store(passages.groupBy("whole", "at", "words", "answer").agg(F.min("item_id").alias("item_id")))
    total = passages.agg(F.sum(F.size("words"))).first()[0] or 0
    count = -(-total // BLOCK_WORDS)
    idf, rarity, words = term_weights(docs) if count else (None, None, 0)
    benches = []
    for block in range(count):
        part = passages.filter(F.pmod(F.xxhash64("item_id", "at", "words"), F.lit(count)) == block).orderBy("item_id", "at", "words").toArrow()
        if not len(part):
            continue
        listed, answers = (part.column(c).combine_chunks() for c in ("words", "answer"))
        firsts = np.concatenate([[0], np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False))])
        unsigned = [tuple(w % 2**64 for w in answer) for answer in answers.to_pylist()]
        benches.append(Benchmark(part.column("item_id").to_pylist(), listed.flatten().to_numpy().view(np.uint64), firsts, unsigned, idf, rarity, words))
    work.clear()
    return benches, idf


def leaks(docs: DataFrame, benchmark: DataFrame) -> Column | None:
    """A column of the benchmark passages that a document's text holds, as (item_id, share, cosine, answered, found).

    All documents give the terms' weights and the latent space, in one pass each, and a third one searches them. A task that
    looks for leaks holds the tables of all blocks. None for a benchmark without words.
    """
    benches, idf = _blocks(docs, benchmark)
    if not benches:
        return None
    bases = latent_bases(docs, idf, benches)
    shared = docs.sparkSession.sparkContext.broadcast((idf, [(bench, *basis) for bench, basis in zip(benches, bases, strict=True)]))
    return _hits(shared)(F.col("text"))


def item_tests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """How each benchmark item can be told from chance in these documents: (item_id, words, test) of each of its passages.

    ``subsequence`` with gaps, in any order if the latent cosine is high; ``word by word`` for those too short or of too common
    words for that; ``none`` for those that any prose may hold, which are never reported as leaks. Items without words have no row.
    """
    benches, _ = _blocks(docs, benchmark)
    rows = [
        (item, int(n), "subsequence" if loose else "word by word" if strict else "none")
        for bench in benches
        for item, n, loose, strict in zip(bench.ids, np.diff(bench.firsts), bench.loose, bench.strict, strict=True)
    ]
    return docs.sparkSession.createDataFrame(rows, "item_id long, words long, test string")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, share, cosine, answered, found of every benchmark item that a document holds.

    ``found`` tells how: by a common ``subsequence`` of three quarters of the item's words within one and a half times its
    length; ``word by word``, the only way for items of few or common words; by half of them around its ``answer``; or
    ``latent``, as a paraphrase whose latent cosine is high and which has most of its rarity, or its answer's telling words, in
    any order. Items that any prose may hold by chance are not reported (``item_tests`` lists them).

    Words are runs of letters and digits of the whole text, lower-cased, and pairs of neighbours in scripts written
    without blanks. A null or empty text, or one without words, holds nothing; so does an item like that. Items of the same
    words are one, under their smallest id; items of more than a window of words leak by any of their passages. Items with a null id
    are searched for like others, and reported once a document, under a null item_id. Null and repeated doc_ids are
    reported row by row; an empty table, or an empty benchmark, gives no rows.
    """
    hits = leaks(docs, benchmark)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if hits is None:
        return found.limit(0).selectExpr("doc_id", "0L AS item_id", "0D AS share", "0D AS cosine", "false AS answered", "'' AS found")
    return found.select("doc_id", F.explode(hits).alias("hit")).select("doc_id", "hit.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    hits = leaks(docs, benchmark)
    return docs if hits is None else docs.filter(F.size(hits) == 0)
