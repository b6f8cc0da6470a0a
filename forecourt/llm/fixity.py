"""Fixity of an archive's replicas: Merkle trees over records and ordered offset ranges."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.support import Work, shuffle_partitions, small

#: Bytes of an offset range, whose records are a leaf, and nodes that share a parent.
RANGE, FAN = 1 << 20, 16


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record of a page; null fields are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def index_records(work: Work, pages: DataFrame, copy: Column | None = None) -> DataFrame:
    """The archive's index: page_id, offset, length, digest of every record, in the order of page_id.

    Range partitions are stored with their ids; the records before a partition are summed from the partitions'
    totals, those before a record within its partition. Equal ids follow by digest, a null id comes first; equal records
    are spread over partitions like others.
    ``copy`` is a record as a replica holds it at the same offset, null if it is lost; it gives the
    columns copy_length and copy_digest.
    """
    own = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    order = [F.col("page_id").asc_nulls_first(), F.col("digest").asc(), F.col("row")]  # the last key parts equal records
    sides = {"": own, "copy_": own if copy is None else copy}
    figures = [f(F.col(f"{side}record")).alias(f"{side}{name}") for side in sides for name, f in (("length", lambda x: F.octet_length(x).cast("long")), ("digest", lambda x: F.sha2(x, 256)))]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), *[x.alias(f"{side}record") for side, x in sides.items()], F.monotonically_increasing_id().alias("row")).select("page_id", "row", *figures)
    dealt = work.store(rows.repartitionByRange(shuffle_partitions(pages.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.sum("length").alias("bytes")).select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    offset = F.col("start") + F.sum("length").over(within) - F.col("length")
    return work.store(
        dealt.join(F.broadcast(starts), "part")  # a row per range partition
        .select("page_id", offset.alias("offset"), "length", "digest", "copy_length", "copy_digest")
    )


def fixity_tree(work: Work, records: DataFrame) -> list[DataFrame]:
    """Levels of the tree, leaves first: (node, hash). A leaf hashes the records that begin in its range,
    a node above it its children, all in order; the last level is the root."""
    entry = F.struct("offset", F.concat_ws(":", "offset", "length", "digest").alias("text"))
    hashed = lambda texts: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(texts)), lambda x: x["text"]), "\n"), 256)
    leaves = records.groupBy(F.floor(F.col("offset") / RANGE).cast("long").alias("node")).agg(hashed(entry).alias("hash"))
    levels = [work.store(leaves)]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        child = F.struct("node", F.concat_ws(":", "node", "hash").alias("text"))
        up = levels[-1].withColumn("parent", F.floor(F.col("node") / FAN).cast("long"))
        levels.append(work.store(up.groupBy(F.col("parent").alias("node")).agg(hashed(child).alias("hash"))))
    return levels


def _differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes of a level whose hashes differ or that one side lacks."""
    pair = ours.alias("a").join(theirs.alias("b"), F.col("a.node") == F.col("b.node"), "full_outer")
    return pair.filter(~F.col("a.hash").eqNullSafe(F.col("b.hash"))).select(F.coalesce("a.node", "b.node").alias("node"))


def audit(work: Work, records: DataFrame, replica: DataFrame) -> DataFrame:
    """Records in which a replica differs: page_id, offset, length, leaf, status (changed, missing, extra).

    Both sides have the columns of ``index_records``, with offsets from the archive's index. Roots are compared
    first; from level to level only the children of differing nodes are, and at last the records of differing
    leaves. Equal replicas end at the root. Trees of different height differ from their highest common level on.
    """
    ours, theirs = fixity_tree(work, records), fixity_tree(work, replica)
    height = min(len(ours), len(theirs))
    bad = work.store(_differing(ours[height - 1], theirs[height - 1]))
    for level in range(height - 2, -1, -1):
        if bad.isEmpty():
            break
        of = small(bad.withColumnRenamed("node", "parent"))
        child = lambda nodes: nodes.withColumn("parent", F.floor(F.col("node") / FAN).cast("long")).join(of, "parent", "left_semi").drop("parent")
        bad = work.store(_differing(child(ours[level]), child(theirs[level])))
    leaf = F.floor(F.col("offset") / RANGE).cast("long")
    of = small(bad.withColumnRenamed("node", "leaf"))
    held = lambda rows, name: rows.withColumn("leaf", leaf).join(of, "leaf", "left_semi").alias(name)
    pair = held(records, "a").join(held(replica, "b"), F.col("a.offset") == F.col("b.offset"), "full_outer")
    status = F.when(F.col("b.offset").isNull(), "missing").when(F.col("a.offset").isNull(), "extra").otherwise("changed")
    both = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    return pair.filter(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select(
        both("page_id"), both("offset"), both("length"), both("leaf"), status.alias("status")
    )


def _damaged() -> Column:
    """The records of a replica with one byte changed, the end cut off, or nothing left, by page_id."""
    page, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    middle = (F.length(html) / 2).cast("int")
    changed = F.concat(F.left(html, middle), F.lit("\u0007"), F.substring(html, middle + 2, F.length(html)))
    held = F.when(page % 97 == 13, changed).when(page % 211 == 5, F.left(html, middle)).otherwise(html)
    return F.when(~F.coalesce(page % 193 == 50, F.lit(False)), warc_record(page, F.col("url"), held))


def audit_damaged_replica(pages: DataFrame) -> DataFrame:
    """Audit a replica of all pages' records that is damaged in known places."""
    work = Work(pages.sparkSession)
    index = index_records(work, pages, _damaged())
    replica = index.filter("copy_digest IS NOT NULL").select("page_id", "offset", F.col("copy_length").alias("length"), F.col("copy_digest").alias("digest"))
    return audit(work, index.select("page_id", "offset", "length", "digest"), replica)


def _record_sql(html: str) -> str:
    return (
        "'WARC/1.1' || E'\\r\\n' || 'WARC-Type: response' || E'\\r\\n' || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || E'\\r\\n'"
        " || 'WARC-Target-URI: ' || coalesce(url, '') || E'\\r\\n' || 'Content-Length: ' || strlen({0}) || E'\\r\\n\\r\\n' || {0} || E'\\r\\n\\r\\n'".format(html)
    )


ORACLE_SQL = f"""
WITH held AS (
  SELECT *, coalesce(html, '') AS body, CAST(floor(length(coalesce(html, '')) / 2) AS INT) AS middle FROM pages
), copies AS (
  SELECT *, CASE WHEN page_id % 97 = 13 THEN left(body, middle) || chr(7) || substr(body, middle + 2)
    WHEN page_id % 211 = 5 THEN left(body, middle) ELSE body END AS copy FROM held
), records AS (
  SELECT page_id, {_record_sql('body')} AS record, CASE WHEN page_id % 193 = 50 THEN NULL ELSE {_record_sql('copy')} END AS other FROM copies
), placed AS (
  SELECT page_id, record, other, strlen(record) AS length,
    CAST(sum(strlen(record)) OVER (ORDER BY page_id NULLS FIRST, sha256(record) ROWS UNBOUNDED PRECEDING) - strlen(record) AS BIGINT) AS "offset"
  FROM records
)
SELECT page_id, "offset", length, CAST(floor("offset" / {RANGE}) AS BIGINT) AS leaf, CASE WHEN other IS NULL THEN 'missing' ELSE 'changed' END AS status
FROM placed WHERE record IS DISTINCT FROM other
"""
