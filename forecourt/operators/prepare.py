"""Bronze to silver: choose manufacturers, sample, drop columns, keep valid rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt import schemas as S


def filter_manufacturers(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows of the given manufacturers (exact, case-sensitive); a null manufacturer is dropped."""
    return df.filter(F.col("manufacturer").isin(S.TARGET_MANUFACTURERS if names is None else names))


def hash_share(fraction: float, key: list[str]) -> Column:
    """True for ``fraction`` of the keys, chosen by hash: the same rows in every run and engine."""
    if fraction >= 1:
        return F.lit(True)
    limit = f"{int(fraction * 2**32):08x}"
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return F.substring(digest, 1, 8) < F.lit(limit)


def sample_rows(
    df: DataFrame,
    fraction: float = S.SAMPLE_FRACTION,
    seed: int | None = None,
    key: list[str] | None = None,
) -> DataFrame:
    """Sample without replacement: per row at random, or by hash of row-unique ``key`` columns."""
    if key is not None:
        return df.filter(hash_share(fraction, key))
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def drop_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop columns that the later steps do not use; absent names are ignored."""
    return df.drop(*(S.COLUMNS_TO_DROP if names is None else names))


def is_valid() -> Column:
    """Price other than zero, and price, year, model and odometer present (a negative price passes)."""
    present = [F.col(c).isNotNull() for c in ("year", "model", "odometer", "price")]
    test = F.col("price") != 0
    for p in present:
        test = test & p
    return test


def filter_valid(df: DataFrame) -> DataFrame:
    return df.filter(is_valid())


def stage_counts(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows left after each filter of a chain, counted in one pass: (position, stage, n_rows).

    ``stages`` maps stage names to predicates in chain order; a row counts for a stage
    when it passes this and every earlier predicate.
    """
    passed, counts = F.lit(True), []
    for name, test in stages.items():
        passed = passed & F.coalesce(test, F.lit(False))
        counts.append(F.count_if(passed).alias(name))
    one_row = df.agg(*counts)
    listed = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"), F.col(f"`{name}`").alias("n_rows"))
        for i, name in enumerate(stages)
    ])
    return one_row.select(F.inline(listed))
