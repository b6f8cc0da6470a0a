"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.support import Work


def components(work: Work, links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link; the label is the smallest node reachable.

    Alternates two steps until the links are stars: every node links its larger neighbours, then its
    smaller ones, to the smallest it knows. Rounds grow with the logarithm of the number of
    nodes; each is stored, so that none is computed again.
    """
    edges = work.store(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label")).filter("node <> label").distinct())
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("label").alias("node"), F.col("node").alias("label")))
        least = both.groupBy("node").agg(F.min("label").alias("least")).withColumn("least", F.least("node", "least"))
        larger = both.filter("label > node").join(least, "node").select(F.col("label").alias("node"), F.col("least").alias("label"))
        large = larger.filter("node <> label").distinct()
        least = large.groupBy("node").agg(F.min("label").alias("least"))
        kept = large.join(least, "node")
        small = kept.select(F.explode(F.array(
            F.struct("node", F.col("least").alias("label")), F.struct(F.col("label").alias("node"), F.col("least").alias("label"))
        )).alias("e")).select("e.*").filter("node <> label").distinct()
        stored = work.store(small)
        work.drop(edges)
        edges = stored
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()
        if state == known:
            return edges
        known = state
