"""Fill-in-the-middle: texts cut at two units located by rank queries on a wavelet matrix over byte classes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.support import carried, unpacked
from forecourt.llm.words import BLANK, portions

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares of 100 that are transformed, and of these that are in suffix-prefix-middle order.
TRANSFORMED, SPM = 50, 80
SEED = "42"

# Classes of the bytes of a text: what the byte is, and by the low bit whether it ends a unit.
_INNER, _BLANK, _LEAD = 0, 2, 4  # inner byte of a character, blank, first byte of another character
_LEVELS = 3
_WORD = 64  # bits of a word whose set bits are counted before it

OUTPUT = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


class WaveletMatrix:
    """Symbols of ``levels`` bits, held as one bit vector a level with counts of the set bits before each word.

    A level holds the symbols' bits from the highest down, each in the order that the levels above left: zeros
    first, each side in its former order. ``rank`` follows one symbol down the levels, a count per level.
    """

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels = len(symbols), levels
        self.bits, self.before, self.zeros = [], [], []
        order = symbols
        for level in range(levels - 1, -1, -1):
            bit = (order >> level) & 1
            packed = np.packbits(np.append(bit, np.zeros(-self.n % _WORD + _WORD, bit.dtype)), bitorder="little").view("<u8")
            ones = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.before.append(np.cumsum(ones) - ones)
            self.zeros.append(self.n - int(ones.sum()))
            order = np.concatenate([order[bit == 0], order[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Set bits of a level before place ``i``."""
        word, rest = i // _WORD, (i % _WORD).astype(np.uint64)
        low = self.bits[level][word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(low).astype(np.int64)

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How many of the first ``i`` symbols are ``symbol``, for every ``i``."""
        first, at = np.zeros_like(i), i
        for level in range(self.levels):
            if symbol >> (self.levels - 1 - level) & 1:
                first, at = (self.zeros[level] + self._ones(level, x) for x in (first, at))
            else:
                first, at = (x - self._ones(level, x) for x in (first, at))
        return at - first


class Units:
    """The units of a portion of texts: blanks with the run of other characters after them, or blanks at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        blank = BLANK[data]
        ends = np.ones(len(data), dtype=bool)
        ends[:-1] = ~blank[:-1] & blank[1:]
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        ends[last] = True  # the end of a text, where the next byte is another text's
        kind = np.where(blank, _BLANK, np.where(data & 0xC0 == 0x80, _INNER, _LEAD))
        self.matrix = WaveletMatrix((kind + ends).astype(np.uint8), _LEVELS)
        self.first, self.end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        self.n = self.boundaries(self.end) - self.boundaries(self.first)

    def boundaries(self, i: np.ndarray) -> np.ndarray:
        """Units that end within the first ``i`` bytes."""
        return sum(self.matrix.rank(kind + 1, i) for kind in (_INNER, _BLANK, _LEAD))

    def characters(self, i: np.ndarray) -> np.ndarray:
        """Characters that begin within the first ``i`` bytes."""
        return i - self.matrix.rank(_INNER, i) - self.matrix.rank(_INNER + 1, i)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The byte after each text's first so many units: bisection for the least place with as many boundaries."""
        wanted = self.boundaries(self.first) + units
        low, high = self.first.copy(), self.end.copy()
        while (low < high).any():
            middle = (low + high) // 2
            short = self.boundaries(middle) < wanted
            low, high = np.where(short & (low < high), middle + 1, low), np.where(short, high, middle)
        return low


def _cuts(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Units of each text, characters before its first cut and between its cuts."""
    columns = [[np.zeros(0, np.int64)] for _ in range(3)]
    one, two = (h.to_numpy(zero_copy_only=False) for h in (h1, h2))
    for first, end, data, offsets in portions(texts):
        units = Units(data, offsets)
        a, b = one[first:end] % (units.n + 1), two[first:end] % (units.n + 1)
        start, low, high = (units.characters(x) for x in (units.first, units.cut(np.minimum(a, b)), units.cut(np.maximum(a, b))))
        for column, values in zip(columns, (units.n, low - start, high - low), strict=True):
            column.append(values)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["n", "prefix_chars", "middle_chars"])


def rearranged(docs: DataFrame, seed: str = SEED, transformed: int = TRANSFORMED, spm: int = SPM, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document's text as it is learned from: plain, or its parts in another order behind their marks.

    A text is cut into n units, each a run of characters with the blanks before it (blanks alone at the end). Four
    numbers, the digest of seed and doc_id, choose two cuts from 0 to n units and the form: ``transformed`` of 100
    texts are rearranged, ``spm`` of 100 of these as suffix, prefix, middle and the others as prefix, suffix,
    middle. A text that is empty or holds a mark stays plain, so that ``restored`` always gives it back. Whole texts
    are cut, at code points, a portion of about 4 MB at a time and a longer text alone; nothing is shuffled.

    A null text is empty; a null doc_id counts as the empty string in the digest; repeated rows get equal results; an
    empty table gives no rows. Returns the ``OUTPUT`` columns (characters null for plain texts) and those in ``carry``
    that are not named like one of them.
    """
    doc_id = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    cut = docs.select(doc_id.alias("doc_id"), text.alias("_text"), digest.alias("_digest"), carried(docs, carry, OUTPUT).alias("carried")).withColumn(
        "_cuts", F.arrow_udf(_cuts, "n long, prefix_chars long, middle_chars long")("_text", h[0], h[1])
    )
    marked = F.regexp_like("_text", F.lit("<[PSM]>"))
    form = (
        F.when((F.col("_text") == "") | marked | (h[2] % 100 >= transformed), "plain")
        .when(h[3] % 100 < spm, "spm").otherwise("psm")
    )
    parts = cut.withColumn("form", form).select(
        "*", *[F.when(F.col("form") != "plain", F.col("_cuts")[c]).alias(c) for c in ("prefix_chars", "middle_chars")]
    )
    at = F.col("prefix_chars").cast("int"), (F.col("prefix_chars") + F.col("middle_chars")).cast("int")
    prefix = F.substring("_text", F.lit(1), at[0])
    middle = F.substring("_text", at[0] + 1, F.col("middle_chars").cast("int"))
    suffix = F.substring("_text", at[1] + 1, F.length("_text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("_text"))
    )
    return parts.select(
        "doc_id", F.col("_cuts.n").alias("n"), "form", "prefix_chars", "middle_chars", output.alias("output"), *unpacked(carry, OUTPUT)
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``rearranged`` was given, from its output and form alone."""
    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(one) + len(second) + 1, F.length(rest))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    first_suffix, then_prefix, last_middle = between(SUFFIX, PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(then_prefix, last_middle, first_suffix))
        .otherwise(output)
    )


def digests(docs: DataFrame) -> DataFrame:
    """The transformed documents with digests of output and restored text in place of the output."""
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return rearranged(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


_BLANKS = r"\x20\x09-\x0D"
_NUMBERS = [f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4)]
ORACLE_SQL = rf"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cut AS (
  SELECT doc_id, text, {', '.join(_NUMBERS)},
    regexp_extract_all(text, '[{_BLANKS}]*[^{_BLANKS}]+|[{_BLANKS}]+') AS units FROM hashed
), placed AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
