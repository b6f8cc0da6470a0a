"""Null profile of a table and the report on what enrichment recovered."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_missing(value: Column, kind: T.DataType) -> Column:
    """Null, or NaN where the type has it."""
    missing = value.isNull()
    return missing | F.isnan(value) if isinstance(kind, (T.FloatType, T.DoubleType)) else missing


def _null_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(is_missing(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in df.schema]


def null_profile(df: DataFrame) -> DataFrame:
    """Null (or NaN) cells per column, counted in one pass: (column_name, n_nulls, n_rows)."""
    counted = df.agg(F.struct(*_null_counts(df)).alias("nulls"), F.count("*").alias("n_rows"))
    listed = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col("nulls")[c].alias("n_nulls"), F.col("n_rows").alias("n_rows"))
        for c in df.columns
    ])
    return counted.select(F.inline(listed))


def recovery_report(before: DataFrame, after: DataFrame, same_columns: bool = True) -> DataFrame:
    """Null cells before and after: (initial_nulls, final_nulls, recovered, percentage).

    With ``same_columns`` only columns of both tables count; without it, nulls of
    columns that were dropped in between count as recovered.
    """
    if same_columns:
        common = [c for c in before.columns if c in after.columns]
        before, after = before.select(*common), after.select(*common)
    first = null_profile(before).select(F.col("n_nulls").alias("initial"), F.lit(0).cast("long").alias("final"))
    last = null_profile(after).select(F.lit(0).cast("long").alias("initial"), F.col("n_nulls").alias("final"))
    sums = first.unionByName(last).agg(F.sum("initial").alias("initial_nulls"), F.sum("final").alias("final_nulls"))
    return sums.select(*_report())


def _report() -> list[Column]:
    initial, final = F.col("initial_nulls"), F.col("final_nulls")
    share = F.round((initial - final) / F.nullif(initial, F.lit(0)) * 100, 2)
    return [initial, final, (initial - final).alias("recovered"), F.coalesce(share, F.lit(0.0)).alias("percentage")]


def missing_cells(cells: list[tuple[Column, T.DataType]]) -> Column:
    """How many of a row's cells are null (or NaN)."""
    return sum((is_missing(value, kind).cast("long") for value, kind in cells), F.lit(0).cast("long"))


def observed_report(spark: SparkSession, counted: Observation) -> DataFrame:
    """The report of a merge from what was counted while its result was written."""
    found = counted.get
    return spark.createDataFrame([(found["initial_nulls"] or 0, found["final_nulls"] or 0)], "initial_nulls long, final_nulls long").select(*_report())


def counted_report(counts: DataFrame) -> DataFrame:
    """The report from rows with their missing cells before and after, ``initial`` and ``final``: one scan."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return counts.agg(total("initial").alias("initial_nulls"), total("final").alias("final_nulls")).select(*_report())
