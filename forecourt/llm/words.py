"""Words of whole texts as 64-bit hashes, for a batch of texts at a time."""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_RANDOM = np.random.default_rng(20)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Separates runs of ASCII letters and bytes of other letters.
NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
#: The same with digits as characters of words.
NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLDED = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
#: A random number for each of a word's first so many places and each byte there; later places
#: take them again, times a power of an odd number.
_PLACES = 64
_BYTE = _RANDOM.integers(1, 2**64, (_PLACES, 256), dtype=np.uint64)[:, _FOLDED].ravel()
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Texts are worked on in portions of about so many bytes.
PORTION = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def portions(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts; null counts as empty, a long text is a portion alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PORTION, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, firsts): byte spans of the words of all texts, and where each text's words begin.

    ``blank`` tells of each byte whether it separates words.
    """
    inside = ~blank[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    opens[borders] = inside[borders]
    closes[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK, heads: tuple[int, ...] = ()
) -> tuple[np.ndarray, ...]:
    """(hashes, firsts): A-Z count as a-z; words of text i are ``hashes[firsts[i]:firsts[i + 1]]``.

    For each of ``heads``, hashes of the words' first so many bytes follow.
    """
    starts, ends, firsts = word_spans(data, offsets, blank)
    if not len(starts):
        return (np.zeros(0, np.uint64), firsts, *[np.zeros(0, np.uint64) for _ in heads])
    lengths = (ends - starts).astype(np.int32)
    at = np.cumsum(lengths, dtype=np.int32) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(at, lengths)
    bytes_ = data[~blank[data]]
    longest = int(lengths.max())
    terms = _BYTE[(place % _PLACES if longest > _PLACES else place) * 256 + bytes_]
    if longest > _PLACES:
        terms *= _powers(longest // _PLACES + 1)[place // _PLACES]
    summed = lambda t, n: mixed(np.add.reduceat(t, at) + n.astype(np.uint64))
    return (summed(terms, lengths), firsts, *[summed(np.where(place < h, terms, 0), np.minimum(lengths, h).astype(np.int64) + (h << 32)) for h in heads])


#: Scripts that are written without blanks.
_NO_BLANKS = "".join(rf"\p{{{script}}}" for script in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
_SEPARATES, _IN_WORD, _NO_BLANK = range(3)


@cache
def _classes() -> np.ndarray:
    """Of every code point whether it separates words, is a character of words or one of a script without blanks."""
    everything = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    classes = np.full(0x110000, _SEPARATES, dtype=np.uint8)
    for kind, pattern in ((_IN_WORD, r"[\p{L}\p{M}\p{N}]"), (_NO_BLANK, f"[{_NO_BLANKS}]")):
        classes[np.frombuffer("".join(regex.findall(pattern, everything)).encode("utf-32-le"), dtype="<u4")] = kind
    return classes


def _wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, lengths, classes) of the characters outside ASCII."""
    lead = np.flatnonzero(data >= 0xC0)
    padded = np.append(data, np.zeros(4, np.uint8))
    first = padded[lead].astype(np.int64)
    length = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & (0x7F >> length)
    for k in range(1, 4):
        point = np.where(length > k, point << 6 | padded[lead + k].astype(np.int64) & 0x3F, point)
    return lead, length, _classes()[np.minimum(point, 0x10FFFF)]


_RUNS_WITHOUT_BLANKS = regex.compile(f"[{_NO_BLANKS}]+")


def _in_pairs(text: str) -> str:
    """The text with runs of scripts without blanks as pairs of neighbours, a lone character as itself."""
    pairs = lambda run: " " + " ".join(run[i : i + 2] for i in range(max(len(run) - 1, 1))) + " "
    return _RUNS_WITHOUT_BLANKS.sub(lambda match: pairs(match[0]), text)


def split_portions(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``portions`` of the lower-cased texts whose words, by Unicode class, are runs of ASCII letters and digits and bytes from 128 on.

    Characters outside ASCII that are no letters, marks or digits become blanks, and runs of scripts without blanks
    their pairs of neighbours.
    """
    for first, end, data, offsets in portions(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))):
        place, length, kind = _wide(data)
        if (kind == _NO_BLANK).any():
            some = set((np.searchsorted(offsets, place[kind == _NO_BLANK], side="right") - 1).tolist())
            parts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(end - first)]
            parts = [_in_pairs(p.decode()).encode() if i in some else p for i, p in enumerate(parts)]
            data = np.frombuffer(b"".join(parts), dtype=np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            place, length, kind = _wide(data)
        blank, size = place[kind == _SEPARATES], length[kind == _SEPARATES]
        if len(blank):
            data = data.copy()
            for k in range(4):
                data[blank[size > k] + k] = 0x20
        yield first, end, data, offsets
