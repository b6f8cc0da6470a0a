"""Mixing sources to target weights by Pareto order sampling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.support import Work, carried, small, unpacked, word_count

WEIGHTS = (3, 1, 2)
OUTPUT = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")
_BITS = 10  # of the rank that each of the two passes to a cut resolves


def uniform(seed: str, doc_id: Column, text: Column) -> Column:
    """A number between 0 and 1 that depends on the document alone, so that reruns agree."""
    drawn = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(2.0**52)


def targets(sizes: DataFrame, share: float, weights: tuple[int, ...], most: int) -> DataFrame:
    """Words to take from each source. ``sizes`` has a row per source: key, source, source_size.

    Sources in code point order, null last, weigh ``weights`` in turn. Full ones stop at
    ``most`` times their size: going up by (most * size / weight), the first source whose
    share of what is left lies below its bound sets the level for itself and all after it.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    fullest = Window.orderBy(F.col("bound") / F.col("weight"), "place")
    free = F.col("level") * F.col("weight") < F.col("bound")
    return (
        sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight)
        .withColumn("bound", F.col("source_size") * most)
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("bound").over(fullest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(fullest.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.col("full")) / F.col("rest"))
        .withColumn("common", F.max(F.when(free, F.col("level"))).over(everything))
        .withColumn("target", F.when(free, F.col("common") * F.col("weight")).otherwise(F.col("bound").cast("double")))
        .select("key", "source", "source_size", "target")
    )


def expected_copies(classes: DataFrame, most: int) -> DataFrame:
    """Whole copies and the chance of one more, for each source and class of sizes.

    ``classes`` has key, source_size, target, level, words: a document of ``level`` binary
    digits of words is expected ``min(most, c * level)`` times, with the ``c`` that meets its source's
    target. Going down by level, the first one not cut off at ``most`` gives ``c``.
    """
    down = Window.partitionBy("key").orderBy(F.desc("level"))
    full = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("level") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = Window.partitionBy("key")
    scale = F.when(F.col("rest") > 0, (F.col("target") - F.col("full") * most) / F.col("rest"))
    fits = F.col("scale") * F.col("level") <= most
    expected = F.when(F.col("factor").isNull(), F.when(F.col("target") > 0, F.lit(float(most))).otherwise(0.0)).otherwise(
        F.least(F.col("factor") * F.col("level"), F.lit(float(most)))
    )
    return (
        classes.withColumn("full", full).withColumn("rest", rest).withColumn("scale", scale)
        .withColumn("factor", F.max_by("scale", F.when(fits, F.col("level"))).over(whole))
        .withColumn("expected", expected)
        .withColumn("certain", F.floor("expected").cast("long"))
        .withColumn("chance", F.col("expected") - F.col("certain"))
        .withColumn("need", F.col("target") - F.sum(F.col("certain") * F.col("words")).over(whole))
        .select("key", "source_size", "target", "level", "certain", "chance", "need")
    )


def _buckets(rows: DataFrame, bucket: Column, need: str, out: str) -> DataFrame:
    """Per source, the bucket in which the running sum of sizes passes the need, and the sum before it."""
    upto = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("key", need, bucket.alias("bucket")).agg(F.sum("size").alias("sum"))
    return (
        sums.withColumn("end", F.sum("sum").over(upto))
        .filter(F.col("end") > F.col(need))
        .groupBy("key").agg(F.min_by(F.struct("bucket", (F.col("end") - F.col("sum")).alias("before")), "bucket").alias("b"))
        .select("key", F.col("b.bucket").alias(out), F.col("b.before").alias(f"{out}_before"))
    )


def _stops(work: Work, ranked: DataFrame, nearest: bool) -> DataFrame:
    """Per source, where its ranked documents reach its ``need``: (key, stop, last_odds, last_row, gap).

    A document is chosen if its code is below ``stop``, or is equal and (odds, row) is at most
    the last; without a stop all are. Two passes over sums by code narrow the place down to a code of 20 bits,
    whose documents alone are sorted. ``nearest`` takes the last one if at least half of it is needed.
    ``gap`` is what is needed still.
    """
    whole = work.store(ranked.groupBy("key", "need").agg(F.sum("size").alias("sum")))
    coarse = work.store(_buckets(ranked, F.shiftright("code", _BITS), "need", "coarse"))
    inside = ranked.join(small(coarse), "key").filter(F.shiftright("code", _BITS) == F.col("coarse"))
    inside = inside.withColumn("need_2", F.col("need") - F.col("coarse_before"))
    fine = _buckets(inside, F.col("code"), "need_2", "stop").join(coarse, "key")
    fine = work.store(fine.select("key", "stop", (F.col("stop_before") + F.col("coarse_before")).alias("before")))
    tied = ranked.join(small(fine), "key").filter(F.col("code") == F.col("stop"))
    upto = Window.partitionBy("key").orderBy("odds", "row").rowsBetween(Window.unboundedPreceding, 0)
    chosen = (
        tied.withColumn("reached", F.sum("size").over(upto))
        .filter((F.col("reached") - F.col("size") / 2 if nearest else F.col("reached")) <= F.col("need") - F.col("before"))
        .groupBy("key").agg(F.max(F.struct("odds", "row")).alias("last"), F.max("reached").alias("more"))
    )
    got = F.when(F.col("stop").isNull(), F.col("sum")).otherwise(F.col("before") + F.coalesce("more", F.lit(0)))
    return work.store(
        whole.join(fine, "key", "left").join(chosen, "key", "left")
        .select("key", "stop", F.col("last.odds").alias("last_odds"), F.col("last.row").alias("last_row"), (F.col("need") - got).alias("gap"))
    )


def _chosen() -> Column:
    """Whether a ranked document lies before its source's stop."""
    upto = (F.col("odds") < F.col("last_odds")) | ((F.col("odds") == F.col("last_odds")) & (F.col("row") <= F.col("last_row")))
    return F.col("stop").isNull() | (F.col("code") < F.col("stop")) | ((F.col("code") == F.col("stop")) & F.coalesce(upto, F.lit(False)))


def mix_sources(
    docs: DataFrame,
    share: float = 1.5,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = 2,
    seed: str = "mix",
    carry: tuple[str, ...] = (),
    work: Work | None = None,
) -> DataFrame:
    """How often the mix takes every document: certain whole copies, then a Pareto order sample.

    Longer documents are expected more often, by the binary digits of their number of words. The
    whole part of that expectation is certain. For the rest, documents of a source are ranked
    by random odds divided by inclusion odds and taken in that order up to the words that the
    source still needs. What is left before the first document that was too long is filled with the next
    ones that fit, and at last with one that overshoots by less than is lacking. So a source misses its
    target by less than half of its shortest document left.

    No source is gathered in one task: cuts are found by sums per code of the rank. Words are
    runs of other characters than blanks; a null or empty text has none and is taken as its
    expectation says, with 0 words. A null source is a source of its own, the last; null ids
    and repeated rows are documents like others (equal rows are interchangeable). An empty
    table gives no rows. Returns the ``OUTPUT`` columns and those in ``carry`` that are
    not named like one of them.
    """
    work = work or Work(docs.sparkSession)
    size = word_count(F.col("text"))
    rows = work.store(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"),
        size.alias("size"),
        uniform(seed, F.col("doc_id"), F.col("text")).alias("u"),
        F.monotonically_increasing_id().alias("row"),
        carried(docs, carry, OUTPUT).alias("carried"),
    ).withColumn("level", F.length(F.bin("size"))))
    classes = work.store(rows.groupBy("key", "source", "level").agg(F.sum("size").alias("words")))
    aims = targets(classes.groupBy("key", "source").agg(F.sum("words").alias("source_size")), share, weights, most)
    plan = work.store(expected_copies(classes.drop("source").join(aims.drop("source"), "key"), most))

    odds = F.col("u") / (1 - F.col("u")) / (F.col("chance") / (1 - F.col("chance")))
    code = F.floor(F.col("odds") / (1 + F.col("odds")) * F.lit(2 ** (2 * _BITS))).cast("long")
    planned = rows.join(small(plan), ["key", "level"]).withColumn("odds", F.when(F.col("chance") > 0, odds)).withColumn("code", code)
    state = planned.withColumn("chosen", F.lit(False)).withColumn("room", F.col("need"))
    # All in order up to the need; then those that fit what is left; then one that brings the sum nearer.
    for times in (None, 1, 2):
        fits = F.col("odds").isNotNull() & ~F.col("chosen")
        fits = fits if times is None else fits & (F.col("size") <= times * F.col("room"))
        ranked = state.filter(fits).select("key", "size", "odds", "code", "row", F.col("room").alias("need"))
        stops = small(_stops(work, ranked, nearest=times is not None))
        state = (
            state.join(stops, "key", "left").withColumn("chosen", F.col("chosen") | (fits & _chosen()))
            .withColumn("room", F.coalesce("gap", "room")).drop("stop", "last_odds", "last_row", "gap")
        )
    out = state.withColumn("copies", (F.col("certain") + F.col("chosen").cast("int")).cast("int"))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        *unpacked(carry, OUTPUT),
    )


ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5)
      / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents
), levels AS (SELECT *, length(bin(size)) AS level FROM rows),
sizes AS (SELECT source, sum(size) AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, 2 * source_size AS bound,
    sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS wanted,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sizes
), filled AS (
  SELECT *, (wanted - coalesce(sum(bound) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water
  FROM weighed WINDOW w AS (ORDER BY CAST(bound AS DOUBLE) / weight, place)
), aims AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
    CASE WHEN water * weight < bound THEN max(water) FILTER (WHERE water * weight < bound) OVER () * weight ELSE CAST(bound AS DOUBLE) END AS target
  FROM filled
), classes AS (SELECT source, level, sum(size) AS words FROM levels GROUP BY ALL),
scaled AS (
  SELECT c.*, target, (target - 2 * coalesce(sum(words) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(c.level * words) OVER (d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS scale
  FROM classes c JOIN aims a ON c.source IS NOT DISTINCT FROM a.source
  WINDOW d AS (PARTITION BY c.source ORDER BY c.level DESC)
), factors AS (
  SELECT *, arg_max(scale, level) FILTER (WHERE scale * level <= 2) OVER (PARTITION BY source) AS factor FROM scaled
), expected AS (
  SELECT *, CASE WHEN factor IS NULL THEN CASE WHEN target > 0 THEN 2.0 ELSE 0.0 END ELSE least(factor * level, CAST(2 AS DOUBLE)) END AS e FROM factors
), planned AS (
  SELECT source, level, target, floor(e) AS certain, e - floor(e) AS chance,
    target - sum(floor(e) * words) OVER (PARTITION BY source) AS need FROM expected
), ranked AS (
  SELECT l.*, p.certain, p.need, a.source_size, a.target, CASE WHEN chance > 0 THEN u / (1 - u) / (chance / (1 - chance)) END AS odds,
    row_number() OVER () AS rid
  FROM levels l JOIN planned p ON l.source IS NOT DISTINCT FROM p.source AND l.level = p.level
  JOIN aims a ON l.source IS NOT DISTINCT FROM a.source
), first AS (
  SELECT *, coalesce(odds IS NOT NULL AND sum(size) FILTER (WHERE odds IS NOT NULL) OVER
    (PARTITION BY source ORDER BY odds NULLS LAST, rid ROWS UNBOUNDED PRECEDING) <= need, false) AS one FROM ranked
), gaps AS (
  SELECT *, need - coalesce(sum(size) FILTER (WHERE one) OVER (PARTITION BY source), 0) AS gap FROM first
), second AS (
  SELECT *, odds IS NOT NULL AND NOT one AND size <= gap AS fits FROM gaps
), filled_up AS (
  SELECT *, coalesce(fits AND sum(size) FILTER (WHERE fits) OVER (PARTITION BY source ORDER BY odds NULLS LAST, rid ROWS UNBOUNDED PRECEDING)
    - CAST(size AS DOUBLE) / 2 <= gap, false) AS two FROM second
), gaps_2 AS (
  SELECT *, gap - coalesce(sum(size) FILTER (WHERE two) OVER (PARTITION BY source), 0) AS gap_2 FROM filled_up
), third AS (
  SELECT *, odds IS NOT NULL AND NOT one AND NOT two AND size <= 2 * gap_2 AS near FROM gaps_2
), last AS (
  SELECT *, one OR two OR coalesce(near AND sum(size) FILTER (WHERE near) OVER (PARTITION BY source ORDER BY odds NULLS LAST, rid ROWS UNBOUNDED PRECEDING)
    - CAST(size AS DOUBLE) / 2 <= gap_2, false) AS more FROM third
)
SELECT doc_id, source, size, source_size, target,
  CAST(certain + CASE WHEN more THEN 1 ELSE 0 END AS INT) AS copies,
  CAST(size * (certain + CASE WHEN more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM last
"""
