"""Join plans shared by the lookups: size-checked, skew-safe, and substring joins.

Nothing here broadcasts a table whose size was not counted first, and nothing
compares every needle with every text.
"""

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.functions.text import any_of

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 256 << 20
HEAP_SHARE = 24  # a broadcast takes such a part of the driver's heap at most: it is held there several times over, next to others
RELATION_BYTES = 64  # of a row in a hashed relation, besides its fields: its key, header and place
ROWS_PER_TASK = 4_000_000
GRAM = 3


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets its own, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="forecourt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result as Parquet to the shared folder and cut its lineage.

    Later reads prune columns and push filters down.
    """
    path = f"{shared_folder(df.sparkSession)}/forecourt-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    if (opened := _scratch.get()) is not None:
        opened.append(path)
    return stored


_scratch: ContextVar[list[str] | None] = ContextVar("_scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete what is materialized within, also by helpers, when it ends, but for the tables that are given to the yielded function.

    These must be all that a lazy result still reads. Within another ``scratch`` they belong to that one.
    """
    outer, kept = _scratch.get(), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._stored_at)
        return df

    opened: list[str] = []
    before = _scratch.set(opened)
    try:
        yield keep
    finally:
        _scratch.reset(before)
        for path in opened:
            if path not in kept:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if outer is not None:
            outer.extend(kept)


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` is read from files or rows at hand, with columns and rows picked only, so that reading it again costs no more."""
    waiting = [df._jdf.queryExecution().optimizedPlan()]
    while waiting:
        plan = waiting.pop()
        if plan.getClass().getSimpleName() not in {"Project", "Filter", "LogicalRelation", "HiveTableRelation", "DataSourceV2ScanRelation", "LocalRelation"}:
            return False
        waiting.extend(plan.children().apply(i) for i in range(plan.children().size()))
    return True


def broadcast_bytes(spark: SparkSession) -> int:
    """Bytes that a table may have to be broadcast, by the heap of the driver, which gathers it."""
    return min(BROADCAST_BYTES, spark._jvm.java.lang.Runtime.getRuntime().maxMemory() // HEAP_SHARE)


def _width(df: DataFrame) -> Column:
    """Bytes of a row in a broadcast: the lengths of its texts, 8 for every other field, and ``RELATION_BYTES``; nested values as JSON."""
    parts = [F.lit(RELATION_BYTES)]
    for field in df.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value))
            parts.append(F.coalesce(F.octet_length(value), F.lit(0)))
        elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(value), F.lit(0)) + 8)
        else:
            parts.append(F.lit(8))
    return reduce(lambda a, b: a + b, parts).cast("long")


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int | None = None) -> bool:
    """Count rows and bytes of ``df``, summed per task: a limit would send the rows of all tasks to one.

    ``max_bytes`` is ``broadcast_bytes`` unless given.
    """
    max_bytes = broadcast_bytes(df.sparkSession) if max_bytes is None else max_bytes
    size = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int | None = None) -> DataFrame:
    """``df`` to be joined: broadcast if it is counted to fit, else by shuffle.

    Without a hint Spark goes by the bytes of the files that ``df`` is read from, which are packed, and by those alone when rows
    are repeated afterwards, and may gather a table in the driver that is a hundred times as large.
    """
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df.hint("shuffle_merge")


def keyed_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    small: bool = False,
) -> DataFrame:
    """Equi-join a large ``fact`` with ``dim`` without sending a hot key to one task.

    A ``dim`` counted to be small is broadcast, so ``fact`` is not shuffled. A larger one
    is joined by shuffle, and every key that would give more than ``rows_per_task``
    result rows is cut into parts of that size: the rows of one side take one salt each and
    meet the rows of the other repeated per salt, on both sides where both are large. Pass ``dim`` materialized if it
    is costly to compute. ``how`` is ``inner`` or ``left``; ``small`` says that the caller
    has already shown that ``dim`` fits.
    """
    if small or fits_broadcast(dim, max_rows, max_bytes):
        return fact.join(F.broadcast(dim), keys, how)
    per_key = fact.groupBy(*keys).agg(F.count("*").alias("_facts")).join(
        dim.groupBy(*keys).agg(F.count("*").alias("_dims")).hint("shuffle_merge"), keys, how
    )
    facts, dims = F.col("_facts").cast("double"), F.coalesce("_dims", F.lit(1)).cast("double")
    parts = F.ceil(facts * dims / rows_per_task)
    # The share of cuts on each side that repeats the fewest rows; a left join cannot cut dim.
    cut = F.round(F.sqrt(F.col("_parts") * facts / dims)).cast("long") if how == "inner" else F.col("_parts")
    hot = materialize(
        per_key.withColumn("_parts", parts).filter(F.col("_parts") > 1)
        .withColumn("_cut", F.greatest(F.least(cut, F.col("_parts")), F.lit(1).cast("long")))
        .withColumn("_dim_cut", F.ceil(F.col("_parts") / F.col("_cut")))
        .select(*keys, "_cut", "_dim_cut")
    )
    hot = sized(hot, max_rows, max_bytes)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    salts = lambda n: F.explode(F.sequence(zero, F.coalesce(n, one) - 1))
    # The partition id is the same when a lost task runs again; a random salt would not be.
    spread = lambda df: F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in df.columns])
    # Rows with a null key find no partner; a left join still keeps them, so they are spread too.
    no_key = any_of([F.col(k).isNull() for k in keys])
    cut_fact = (
        fact.withColumn("_spread", spread(fact)).join(hot, keys, "left")
        .withColumn("_salt", F.when(no_key, F.col("_spread")).otherwise(F.pmod("_spread", F.coalesce("_cut", one))))
        .withColumn("_dim_salt", salts(F.col("_dim_cut")))
        .drop("_cut", "_dim_cut", "_spread")
    )
    cut_dim = (
        dim.withColumn("_spread", spread(dim)).join(hot, keys, "left")
        .withColumn("_dim_salt", F.pmod("_spread", F.coalesce("_dim_cut", one)))
        .withColumn("_salt", salts(F.col("_cut")))
        .drop("_cut", "_dim_cut", "_spread")
    )
    return cut_fact.join(cut_dim.hint("shuffle_merge"), [*keys, "_salt", "_dim_salt"], how).drop("_salt", "_dim_salt")


def _grams(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(
        F.length(text) >= size,
        F.transform(starts, lambda i: F.substring(text, i, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def _text_grams(text: Column) -> Column:
    """Every gram of 0 to ``GRAM`` characters; the empty gram serves empty needles."""
    parts = [F.array(F.lit(""))] + [_grams(text, n) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(*parts))


def _needle_grams(needle: Column) -> Column:
    """The needle's grams of ``GRAM`` characters, or the whole needle when it is shorter."""
    return F.when(F.length(needle) < GRAM, F.array(needle)).otherwise(F.array_distinct(_grams(needle, GRAM)))


def contains_join(needles: DataFrame, texts: DataFrame, needle: str, text: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Inner join on ``contains(text, needle)`` plus equality of the ``on`` columns.

    A text that contains the needle contains all its grams, so each needle is looked
    up under one gram only, the one found in the fewest texts, and ``contains``
    decides. Texts are posted by number, and only under grams that some needle has: bytes grow
    with a text's length, not its square. A common gram, as those of short needles are, is
    salted. Matching is literal; callers lower-case both sides. A null never matches.
    """
    numbered = materialize(texts.withColumn("_text_id", F.monotonically_increasing_id()))
    grams = materialize(needles.select(*on, needle).distinct().withColumn("_gram", F.explode(_needle_grams(F.col(needle)))))
    asked = grams.select(*on, "_gram").distinct()
    posted = materialize(
        numbered.select(*on, "_text_id", F.explode(_text_grams(F.col(text))).alias("_gram")).join(sized(asked), [*on, "_gram"], "left_semi")
    )
    spread = posted.groupBy(*on, "_gram").agg(F.count("*").alias("_texts"))
    anchors = materialize(
        grams.join(spread, [*on, "_gram"]).groupBy(*on, needle).agg(F.min_by("_gram", F.struct("_texts", "_gram")).alias("_gram"))
    )
    looked_up = keyed_join(posted, anchors, [*on, "_gram"]).select("_text_id", needle)
    found = keyed_join(looked_up, numbered, ["_text_id"]).filter(F.contains(F.col(text), F.col(needle))).drop("_text_id")
    return keyed_join(needles, materialize(found), [*on, needle])
