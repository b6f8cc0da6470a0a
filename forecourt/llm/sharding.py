"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.support import Work, carried, shuffle_partitions, unpacked, utf8_size

OUTPUT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def byte_shards(docs: DataFrame, shards: int = 8, drift: float = 0.01, carry: tuple[str, ...] = (), work: Work | None = None) -> DataFrame:
    """Put every document into one of ``shards`` shards that are contiguous in (digest of the text, doc_id).

    Rows are dealt to range partitions once and stored. The partitions' byte totals, summed
    in order, give each row the number of bytes before it; the cuts lie at equal targets of
    the whole. Equal texts are neighbours: a cut moves to the nearer end of a group of equal
    texts of at most ``drift`` of a target, and else to the nearer end of the row it falls in,
    so shards differ by at most ``drift`` of a target or one document, and a group larger than
    that is split like any other rows. Nothing but one row per partition and one per cut
    reaches the driver, and each partition is a task however often a text or a row is repeated.

    Size is the text's UTF-8 bytes plus 1. A null text has size 1, no checksum, and comes
    first, as does a null doc_id within its text; an empty table gives no rows; repeated rows
    are dealt like others. ``carry`` names columns of ``docs`` to hand through; those named
    like an output column are replaced by it.
    """
    spark = docs.sparkSession
    work = work or Work(spark)
    # The last key parts equal rows, which otherwise all lie in one range.
    order = [F.col("digest").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("row")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.md5("text").alias("digest"),
        (utf8_size(F.col("text")) + 1).alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
        carried(docs, carry, OUTPUT).alias("carried"),
    )
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order)
    stored = work.store(dealt.withColumn("part", F.spark_partition_id()))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    offsets = totals.select(  # a row per range partition
        "part",
        "bytes",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = (
        stored.join(F.broadcast(offsets), "part")
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("place", F.col("rows_before") + F.row_number().over(within) - 1)
    )
    cuts = _cuts(stored, offsets, placed, shards, drift)
    shard = sum((F.when(F.col("start") >= at, 1).otherwise(0) for at, _ in cuts), F.lit(0))
    first = F.element_at(F.array(F.lit(0), *[F.lit(n) for _, n in cuts]).cast("array<long>"), F.col("shard") + 1)
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *unpacked(carry, OUTPUT),
    )


def _cuts(stored, offsets, placed, shards: int, drift: float) -> list[tuple[int, int]]:
    """For each cut its byte and the number of rows before it."""
    spans = offsets.orderBy("part").collect()
    total = spans[-1]["bytes_before"] + spans[-1]["bytes"] if spans else 0
    target = total / shards
    at = [target * k for k in range(1, shards)] if total else []
    parts = [next(s["part"] for s in spans if s["bytes_before"] + s["bytes"] > c) for c in at]
    if not at:
        return [(0, 0)] * (shards - 1)
    hit = F.lit(False)
    for c in at:
        hit = hit | ((F.col("start") <= c) & (F.col("start") + F.col("size") > c))
    found = placed.filter(F.col("part").isin(parts)).filter(hit).select("start", "size", "place", "digest").collect()
    digests = sorted({r["digest"] for r in found if r["digest"] is not None})
    sums = []
    for d in [None, *digests]:
        same = F.col("digest").isNull() if d is None else F.col("digest") == d
        less = F.lit(False) if d is None else F.col("digest").isNull() | (F.col("digest") < d)
        for test in (less, same):
            sums += [F.sum(F.when(test, F.col("size")).otherwise(0)), F.sum(F.when(test, 1).otherwise(0))]
    flat = list(stored.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    groups = {d: flat[4 * i : 4 * i + 4] for i, d in enumerate([None, *digests])}
    cuts = []
    for c in at:
        row = next(r for r in found if r["start"] <= c < r["start"] + r["size"])
        start, place, size, count = groups[row["digest"]]
        if size > drift * target:
            start, place, size, count = row["start"], row["place"], row["size"], 1
        cuts.append((start, place) if c - start <= start + size - c else (start + size, place + count))
    return cuts
