"""Column expressions for text tests and request fields."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = " \t\n\r\x0b\x0c"


def stripped(text: Column) -> Column:
    """Trim blanks, tabs and line breaks on both ends."""
    return F.btrim(text, F.lit(_SPACE))


def contains_ci(text: Column, needle: Column | str, like_wildcards: bool = False) -> Column:
    """Case-insensitive ``contains``; with ``like_wildcards`` ``%`` and ``_`` keep their LIKE meaning."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    if like_wildcards:
        return F.like(F.lower(text), F.concat(F.lit("%"), F.lower(needle), F.lit("%")))
    return F.contains(F.lower(text), F.lower(needle))


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def coerce_components(df: DataFrame, column: str = "components") -> DataFrame:
    """Turn a bare string column into a one-element array; arrays stay as they are, null stays null."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return df
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.array(column)))


def repair_terms(diagnosis: Column, components: Column) -> Column:
    """Sorted distinct search terms of a repair request (empty array: nothing to search for)."""
    none = F.array().cast("array<string>")
    listed = F.filter(F.coalesce(components, none), lambda c: c.isNotNull())
    said = F.when(F.coalesce(diagnosis, F.lit("")) != "", F.array(diagnosis)).otherwise(none)
    return F.array_sort(F.array_distinct(F.transform(F.concat(listed, said), lambda t: F.lower(stripped(t)))))
