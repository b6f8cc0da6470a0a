"""Nearest vectors by cosine: a vantage-point tree per shard, pruned by the triangle inequality."""

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.support import Work

LEAF = 64
#: Rows of a shard, of which one tree is built, and queries that meet a shard at once.
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096
_ULP = 1e-9  # what rounding may add to a distance or a cosine


class Tree:
    """Vantage points over unit vectors, by the length of the chord between them, which is a metric.

    A node holds its vantage point, the largest distance within its inner half, and the least and
    largest in its outer half. Points that are all equally far from the vantage point are a leaf.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        vectors = _in_range(vectors)
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.units = vectors / self.norms[:, None]
        random = np.random.default_rng(len(ids))
        self.nodes: list[tuple] = []
        self.root = self._grow(np.arange(len(ids)), random)

    def _grow(self, rows: np.ndarray, random) -> int:
        here = len(self.nodes)
        self.nodes.append((rows,))
        if len(rows) > LEAF:
            point = int(rows[random.integers(len(rows))])
            far = _chord(self.units[rows] @ self.units[point])
            middle = np.median(far)
            inner = far <= middle
            if inner.all():
                inner = far < middle
            if inner.any():
                spans = (far[inner].max(), far[~inner].min(), far[~inner].max())
                self.nodes[here] = (point, *spans, self._grow(rows[inner], random), self._grow(rows[~inner], random))
        return here

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the ``k`` nearest rows of each query, -inf where there are fewer; not those with its own id.

        A half is skipped if ``factor`` times the least distance that the triangle inequality leaves it
        exceeds the query's k-th best distance: 1 is exact, more skips more.
        """
        queries = _in_range(queries)
        self.own, self.queries, self.k, self.factor = own, queries, k, factor
        self.lengths = np.sqrt((queries * queries).sum(axis=1))
        self.directions = queries / self.lengths[:, None]
        self.scores = np.full((len(own), k), -np.inf)
        self.found = np.full((len(own), k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(own)))
        return self.scores, self.found

    def _reach(self, least: np.ndarray, q: np.ndarray) -> np.ndarray:
        worst = self.scores[q, -1]
        return self.factor * least <= np.where(np.isinf(worst), np.inf, _chord(worst)) + np.sqrt(_ULP)

    def _visit(self, at: int, q: np.ndarray) -> None:
        if not len(q):
            return
        node = self.nodes[at]
        if len(node) == 1:
            self._compare(node[0], q)
            return
        point, inner_most, outer_least, outer_most, inner, outer = node
        far = _chord(self.directions[q] @ self.units[point])
        to_inner, to_outer = far - inner_most, np.maximum(outer_least - far, far - outer_most)
        inside = to_inner <= to_outer
        self._visit(inner, q[inside][self._reach(to_inner[inside], q[inside])])
        self._visit(outer, q[~inside][self._reach(to_outer[~inside], q[~inside])])
        self._visit(outer, q[inside][self._reach(to_outer[inside], q[inside])])
        self._visit(inner, q[~inside][self._reach(to_inner[~inside], q[~inside])])

    def _compare(self, rows: np.ndarray, q: np.ndarray) -> None:
        for i in range(0, len(rows), 1024):
            some = rows[i : i + 1024]
            near = self.directions[q] @ self.units[some].T >= self.scores[q, -1:] - _ULP
            near &= self.ids[some][None, :] != self.own[q][:, None]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            exact = np.full(near.shape, -np.inf)
            x, y = self.queries[q[a]], self.vectors[some[b]]
            exact[a, b] = (x * y).sum(axis=1) / (self.lengths[q[a]] * self.norms[some[b]])
            scores = np.concatenate([self.scores[q], exact], axis=1)
            ids = np.concatenate([self.found[q], np.where(near, self.ids[some][None, :], np.iinfo(np.int64).max)], axis=1)
            best = np.lexsort((ids, -scores), axis=1)[:, : self.k]
            self.scores[q], self.found[q] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


def _in_range(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose squares would overflow or vanish, times a power of two, which changes no cosine; others as they are."""
    exponent = np.frexp(np.abs(vectors).max(axis=1))[1]
    far = np.abs(exponent) > 400
    return np.where(far[:, None], np.ldexp(vectors, -exponent[:, None]), vectors) if far.any() else vectors


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    tree = Tree(rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy()))
    return pd.DataFrame({"dims": [rows["dims"].iat[0]], "shard": [rows["shard"].iat[0]], "tree": [pickle.dumps(tree)]})


def _search(k: int, factor: float):
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries):
            for packed in index["tree"]:
                scores, ids = pickle.loads(packed).search(queries["vec_id"].to_numpy(), np.stack(queries["vector"].to_numpy()), k, factor)
                a, b = np.nonzero(~np.isinf(scores))
                out.append(pd.DataFrame({
                    "query_row": queries["row"].to_numpy()[a], "query_id": queries["vec_id"].to_numpy()[a], "vec_id": ids[a, b], "score": scores[a, b],
                }))
        return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})

    return search


def nearest_vectors(
    embeddings: DataFrame, k: int = 5, every: int = 50, factor: float = 1.0,
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` nearest rows, by cosine in double precision, of every row whose vec_id ``every`` divides.

    Rows are dealt by hash to shards of about ``shard_rows``, of which a tree each is built and stored. Blocks
    of queries meet every shard; a shard gives each query its ``k`` best, and the best of all shards are
    ranked, equal scores by smaller vec_id. With ``factor`` 1 the result is exact; see ``Tree.search``.

    Vectors that are null, zero, or hold a null or a number that is not finite take no part, nor do rows
    without vec_id; vectors meet those of their own length. Rows with the query's id are its own and no
    candidates; other repeated rows are each a candidate, and a repeated query is answered once per row. An
    empty table gives no rows. Returns query_id, rank, vec_id, score.
    """
    work = Work(embeddings.sparkSession)
    vector = F.col("embedding").cast("array<double>")
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = work.store(
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & whole & F.exists("vector", lambda x: x != 0))
        .withColumn("dims", F.size("vector"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    asking = F.count_if(F.col("vec_id") % every == 0).alias("asking")
    counts = rows.groupBy("dims").agg(F.count("*").alias("n"), asking).collect()  # a row for each length of vectors
    shards, blocks = F.lit(1), F.lit(1)
    for dims, n, queries in counts:
        shards = F.when(F.col("dims") == dims, -(-n // shard_rows)).otherwise(shards)
        blocks = F.when(F.col("dims") == dims, max(-(-queries // block_queries), 1)).otherwise(blocks)
    rows = rows.withColumn("shards", shards).withColumn("blocks", blocks)
    spread = F.xxhash64("vec_id", "row")
    index = work.store(
        rows.withColumn("shard", F.pmod(spread, "shards")).select("dims", "shard", "vec_id", "vector")
        .groupBy("dims", "shard").applyInPandas(_build, "dims int, shard long, tree binary")
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    queries = (
        rows.filter(F.col("vec_id") % every == 0)
        .withColumn("block", F.pmod(spread, "blocks").cast("long")).withColumn("shard", upto("shards"))
        .select("dims", "shard", "block", "row", "vec_id", "vector")
    )
    keys = ["dims", "shard", "block"]
    met = index.withColumn("blocks", blocks).withColumn("block", upto("blocks")).select(*keys, "tree").groupBy(*keys).cogroup(queries.groupBy(*keys))
    found = met.applyInPandas(_search(k, factor), "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH vectors AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""
