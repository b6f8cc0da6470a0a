"""What the corpus operators share: stored intermediate results, checked broadcasts, words."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of characters between blanks, the word of every contract here.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many rows, counted, is broadcast; the callers' rows are under 200 bytes each.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets its own, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Work:
    """Tables of one operator call, written as Parquet below the shared folder.

    A stored table cuts the lineage, is read with pruned columns, and survives lost
    executors. ``drop`` removes those that nothing lazy refers to any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
        self._next = 0
        self._stored: list[DataFrame] = []

    def store(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._next:03d}"
        self._next += 1
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._stored_at = path
        self._stored.append(table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._stored_at)
        self._stored = [t for t in self._stored if not any(t is gone for gone in tables)]

    def keep(self, *tables: DataFrame) -> None:
        """Drop all tables but these, which the lazy result reads."""
        self.drop(*[t for t in self._stored if not any(t is kept for kept in tables)])

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table with a broadcast hint if it was counted to have at most ``rows`` rows."""
    return F.broadcast(table) if table.count() <= rows else table


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def carried(df: DataFrame, columns, without=()) -> Column:
    """The columns that an operator hands through, packed so that their names clash with nothing."""
    kept = [F.col(f"`{c}`") for c in columns if c not in without]
    return F.struct(*kept) if kept else F.struct(F.lit(None).cast("int").alias("_nothing"))


def unpacked(columns, without=()) -> list[Column]:
    return [F.col(f"carried.`{c}`") for c in columns if c not in without]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
