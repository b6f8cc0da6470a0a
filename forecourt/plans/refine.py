"""Raw listings to gold, as one plan or table by table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession

from forecourt import schemas as S
from forecourt.operators.enrich import extract_fields_rules, merge_extracted
from forecourt.operators.models import normalize_models, propose_dictionary
from forecourt.operators.prepare import drop_columns, filter_manufacturers, filter_valid, sample_rows
from forecourt.operators.quality import observed_report
from forecourt.sources.files import read_listings, read_repair_catalog
from forecourt.sources.tables import ensure_schema, write_by_maker, write_table

# fixed values: table names
VEHICLES, REPAIRS = "vehicles", "reparations"
CLEANED, NAMED, ENRICHED = "vehicles_cleaned", "vehicles_models_cleaned", "vehicles_enriched"


def silver(
    raw: DataFrame,
    manufacturers: list[str] | None = None,
    fraction: float = 1.0,
    seed: int | None = None,
    key: list[str] | None = None,
) -> DataFrame:
    """Chosen manufacturers, without unused columns and invalid rows; a ``fraction`` below 1 samples."""
    chosen = filter_manufacturers(raw, manufacturers)
    return filter_valid(drop_columns(sample_rows(chosen, fraction, seed, key)))


def gold(
    cleaned: DataFrame,
    dictionary: DataFrame,
    extract: Callable[[DataFrame], DataFrame] = extract_fields_rules,
    legacy_string: bool = False,
) -> DataFrame:
    """Canonical model names, then missing cells filled from the description.

    ``extract`` adds the column ``extracted_data``; the default reads it by rules.
    """
    return merge_extracted(extract(normalize_models(cleaned, dictionary)), legacy_string=legacy_string)


def refresh_tables(
    spark: SparkSession,
    schema: str,
    listings_csv: str,
    repairs_csv: str,
    dictionary: DataFrame | None = None,
    extract: Callable[[DataFrame], DataFrame] = extract_fields_rules,
    fmt: str = "parquet",
    by_maker: bool = False,
    **sampling,
) -> DataFrame:
    """Rebuild all tables of ``schema`` from the two CSV sources and report the recovered cells.

    Every table is replaced, and the report is counted while the last one is written. Without ``dictionary`` the canonical names are proposed from
    the cleaned listings; ``by_maker`` stores the last one in a folder for each maker (``write_by_maker``). ``sampling`` goes to ``silver``.
    """
    ensure_schema(spark, schema)
    store = lambda df, name: write_table(df, f"{schema}.{name}", fmt)
    store(read_repair_catalog(spark, repairs_csv), REPAIRS)
    cleaned = store(silver(store(read_listings(spark, listings_csv), VEHICLES), **sampling), CLEANED)
    names = propose_dictionary(cleaned) if dictionary is None else dictionary
    named = store(normalize_models(cleaned, names), NAMED)
    counted = Observation()
    enriched = merge_extracted(extract(named), counted=counted)
    if by_maker:
        enriched = write_table(enriched, f"{schema}.{ENRICHED}_unordered", fmt)
        write_by_maker(enriched, f"{schema}.{ENRICHED}", fmt)
        spark.sql(f"DROP TABLE {schema}.{ENRICHED}_unordered")
    else:
        store(enriched, ENRICHED)
    return observed_report(spark, counted)
