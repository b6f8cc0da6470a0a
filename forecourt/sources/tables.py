"""Catalog tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAKER_KEY = "maker_key"
OTHER_MAKERS = "other"  # the folder that makers beyond the commonest share
_FOLDER = r"^[ -~]{1,60}$"  # names that any file system holds


def ensure_schema(spark: SparkSession, name: str) -> None:
    """Create a schema unless it exists; ``name`` may be ``catalog.schema``."""
    quoted = ".".join(f"`{part}`" for part in name.split("."))
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted}")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def write_table(df: DataFrame, name: str, fmt: str = "parquet", path: str | None = None) -> DataFrame:
    """Replace table ``name`` with ``df`` and return the stored table.

    ``fmt="delta"`` works where the session has that source; ``path`` makes it an
    external table.
    """
    writer = df.write.mode("overwrite").format(fmt)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def may_hold_maker(wanted: Column) -> Column:
    """Whether a folder of a table by ``write_by_maker`` may hold makers whose lower-cased name contains ``wanted``."""
    return F.contains(MAKER_KEY, wanted) | (F.col(MAKER_KEY) == OTHER_MAKERS)


def write_by_maker(
    df: DataFrame, name: str, fmt: str = "parquet", path: str | None = None, max_folders: int = 1000, files: int | None = None
) -> DataFrame:
    """Replace table ``name`` with ``df``, one folder for each maker, ordered by year, and return the stored table.

    The column ``maker_key`` is added, the lower-cased maker that names the folder: lookups by maker (``comparables``,
    ``market_estimate``) read the folders that may hold it, and files and row groups carry close bounds of the year. Makers
    beyond the ``max_folders`` commonest share one folder, that lookups always read; so do null, empty and very long ones and those outside ASCII. Rows are dealt by ranges of
    (maker, year, hash of the row), about equal in size, so a maker with a third of all rows is written by a third of the tasks. ``files`` is the number of ranges
    (``spark.sql.shuffle.partitions`` unless given). A column ``maker_key`` of ``df`` is replaced. Other columns stay as they are.
    ``df`` is read twice: pass a stored table.
    """
    df = df.drop(MAKER_KEY)
    maker = F.lower(F.col("manufacturer").cast("string"))
    common = df.select(maker.alias("_maker")).filter(F.col("_maker").rlike(_FOLDER)).groupBy("_maker").agg(F.count("*").alias("_n"))
    common = common.orderBy(F.desc("_n"), "_maker").limit(max_folders)
    keyed = df.join(F.broadcast(common.select("_maker")), maker == F.col("_maker"), "left")
    keyed = keyed.withColumn(MAKER_KEY, F.coalesce("_maker", F.lit(OTHER_MAKERS))).drop("_maker")
    year = F.col("year") if "year" in df.columns else F.lit(0)
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    ranges = (MAKER_KEY, year, spread)
    dealt = keyed.repartitionByRange(*([files] if files else []), *ranges).sortWithinPartitions(MAKER_KEY, year)
    writer = dealt.write.mode("overwrite").format(fmt).partitionBy(MAKER_KEY)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def describe_schema(df: DataFrame) -> DataFrame:
    """One row per column of ``df``: (position, name, type)."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def schema_text(spark: SparkSession, name: str) -> str:
    """A table's columns and types in one line, or why it cannot be read."""
    try:
        columns = describe_schema(spark.table(name)).orderBy("position").collect()
    except Exception as error:
        return f"{name} cannot be read ({error})"
    return f"{name}({', '.join(r['name'] + ' ' + r['type'] for r in columns)})"
