"""CSV sources and sinks, and the inventory of source files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import schemas as S


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """Read CSV files with a header; without ``schema`` the types are inferred in an extra pass.

    ``multi_line`` keeps quoted line breaks inside one record. Such files cannot be
    split, so land large inputs as many files; files without quoted line breaks can
    be read with ``multi_line=False`` and are then split by Spark.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_listings(
    spark: SparkSession, path: str, schema: T.StructType | None = S.LISTING, multi_line: bool = True
) -> DataFrame:
    """Raw listings from CSV; pass ``schema=None`` to infer the types."""
    return read_csv(spark, path, schema, multi_line)


def read_with_quarantine(
    spark: SparkSession, path: str, schema: T.StructType = S.LISTING, multi_line: bool = True, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): the records that fit the schema, and the others as (file, record, reason).

    ``reason`` names the fields whose values are none of their type, or says that the number of fields is wrong; a
    record that fits in no other way than its nulls is a row. Both read the files, each in one pass; null or empty values are no fault, and empty files give no rows.
    """
    bad = "_bad_record"
    marked = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    reader = spark.read.option("header", header).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE")
    read = reader.option("columnNameOfCorruptRecord", bad).schema(marked).csv(path)
    # Always true: Spark refuses to read the marks alone, as counting rows or broken records would.
    with_fields = F.concat_ws("", *[F.col(f"`{f.name}`").cast("string") for f in schema.fields]) >= ""
    rows = read.filter(F.col(bad).isNull() & with_fields).drop(bad)
    # The record again, as texts: the fields that have one but no value are the reason.
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    again = F.from_csv(F.col(bad), texts.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"escape": '"', "mode": "PERMISSIVE"})
    wrong = [
        F.when(F.col(f"_again.`{f.name}`").isNotNull() & F.col(f"`{f.name}`").isNull(), F.lit(f.name))
        for f in schema.fields if not isinstance(f.dataType, T.StringType)
    ]
    named = F.array_join(F.array_compact(F.array(*wrong)), ", ")
    quarantine = (
        read.withColumn("_file", F.input_file_name()).filter(F.col(bad).isNotNull() & with_fields).withColumn("_again", again)
        .select(F.col("_file").alias("file"), F.col(bad).alias("record"), F.when(named != "", named).otherwise("number of fields").alias("reason"))
    )
    return rows, quarantine


def read_repair_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Repair price list from CSV."""
    return read_csv(spark, path, S.REPAIR_CATALOG)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write CSV with a header; blanks, line breaks and quotes inside texts are kept.

    One file per partition; ``files`` merges partitions first and is meant for a small
    price list that should be one file.
    """
    out = df if files is None else df.coalesce(files)
    (
        out.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per file below ``path`` plus a total row: (file, bytes, label).

    Only the file listing is read, never file content. A file is labelled in GB when
    it is larger than one, else in MB; the total (``file`` null) is in GB.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    )
    mb = F.col("bytes") / F.lit(1024 * 1024)
    gb = F.col("bytes") / F.lit(1024 * 1024 * 1024)
    total = files.agg(F.lit(None).cast("string").alias("file"), F.sum("bytes").alias("bytes"))
    in_gb = F.format_string("%.2f GB", gb)
    return files.withColumn("label", F.when(gb > 1, in_gb).otherwise(F.format_string("%.2f MB", mb))).unionByName(
        total.withColumn("label", in_gb)
    )
