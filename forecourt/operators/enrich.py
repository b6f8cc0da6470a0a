"""Silver to gold: read fields out of free text and fill missing cells."""

from collections.abc import Callable
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import schemas as S
from forecourt.operators.quality import counted_report, missing_cells
from forecourt.plans.joins import BROADCAST_ROWS, ROWS_PER_TASK, fits_broadcast, keyed_join, materialize

KEY_BUCKETS = 1 << 20

# field -> (pattern on the lower-cased text, group); our own reading of listing texts
RULES: dict[str, tuple[str, int]] = {
    "manufacturer": (
        r"\b(acura|alfa-romeo|aston-martin|audi|bmw|buick|cadillac|chevrolet|chrysler|dodge|ferrari|fiat|ford|gmc|"
        r"harley-davidson|honda|hyundai|infiniti|jaguar|jeep|kia|land rover|lexus|lincoln|mazda|mercedes-benz|mercury|"
        r"mini|mitsubishi|nissan|pontiac|porsche|ram|rover|saturn|subaru|tesla|toyota|volkswagen|volvo)\b", 1),
    "model": (
        r"\b(?:acura|audi|bmw|buick|cadillac|chevrolet|chrysler|dodge|fiat|ford|gmc|honda|hyundai|infiniti|jaguar|jeep|"
        r"kia|lexus|lincoln|mazda|mercedes-benz|mercury|mini|mitsubishi|nissan|pontiac|porsche|ram|saturn|subaru|tesla|"
        r"toyota|volkswagen|volvo)\s+([a-z0-9][a-z0-9-]*)", 1),
    "year": (r"\b(19[3-9][0-9]|20[0-4][0-9])\b", 1),
    "price": (r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)", 1),
    "odometer": (r"\b([0-9][0-9,]*)\s*(?:miles|mile|mi|kms|km)\b", 1),
    "transmission": (r"\b(automatic|manual)\b", 1),
    "fuel": (r"\b(gasoline|gas|diesel|hybrid|electric)\b", 1),
    "drive": (r"\b(4wd|awd|fwd|rwd)\b", 1),
    "type": (r"\b(suv|sedan|hatchback|coupe|convertible|pickup|truck|minivan|van|wagon|bus)\b", 1),
    "paint_color": (r"\b(black|white|silver|grey|gray|red|blue|green|brown|yellow|orange|purple|custom)\b", 1),
    "condition": (r"\b(like new|excellent|good|fair|salvage|new)\b", 1),
}
NUMBERS = ("price", "odometer")


def rule_struct(text: Column, rules: dict[str, tuple[str, int]] = RULES, numbers: tuple[str, ...] = NUMBERS) -> Column:
    """Struct of the first match of every rule on a lower-cased text; no match gives null, numbers lose their commas.

    A match is filtered by a function on arrays: that names it once, so that each rule runs once and only where it is asked
    for, and keeps the rules out of the generated code of the stage, which grows too large to be compiled with all of them.
    """
    fields = []
    for name, (pattern, group) in rules.items():
        found = F.regexp_extract(text, pattern, group)
        if name in numbers:
            found = F.replace(found, F.lit(","), F.lit(""))
        fields.append(F.get(F.filter(F.array(found), lambda value: value != ""), F.lit(0)).alias(name))
    return F.struct(*fields)


def extract_fields_rules(
    df: DataFrame,
    text: str = "description",
    into: str = "extracted_data",
    rules: dict[str, tuple[str, int]] = RULES,
    numbers: tuple[str, ...] = NUMBERS,
    km_per_mile: float | None = None,
) -> DataFrame:
    """Add the extraction struct by rules, JVM-side. ``km_per_mile`` turns mile readings into km."""
    fields = rule_struct(F.col("_low"), rules, numbers)
    if km_per_mile is not None:
        in_miles = F.regexp_like("_low", F.lit(r"\b[0-9][0-9,]*\s*(?:miles|mile|mi)\b"))
        km = F.round(fields["odometer"].try_cast("double") * km_per_mile).cast("long").cast("string")
        fields = fields.withField("odometer", F.when(in_miles, km).otherwise(fields["odometer"]))
    return df.withColumn("_low", F.lower(text)).withColumn(into, fields).drop("_low")


def extract_fields_udf(
    df: DataFrame,
    make_extractor: Callable[[], Callable[[str], dict]],
    text: str = "description",
    into: str = "extracted_data",
    schema: T.StructType = S.EXTRACTED,
    partitions: int | None = None,
) -> DataFrame:
    """Add the extraction struct by the caller's function, Arrow batch by batch.

    ``make_extractor`` is called once per task and returns text -> dict (a client of a
    text service, say). A call that raises, or returns no dict, gives null fields;
    missing keys are null, extra keys are ignored, values become strings.
    ``partitions`` sets the number of tasks, and with it the parallel calls, at the price
    of a shuffle of whole rows; ``None`` keeps the partitioning of the input.
    """
    kept = [c for c in df.columns if c != into]
    rows = df.select(*kept) if partitions is None else df.select(*kept).repartition(partitions)
    told = rows.withColumn("_told", _caller(make_extractor, schema)(F.col(text)))
    return told.withColumn(into, F.struct(*[F.col(f"_told.`{n}`").alias(n) for n in schema.names])).drop("_told")


def _caller(make_extractor: Callable[[], Callable[[str], dict]], schema: T.StructType):
    """The caller's function on batches: the fields as strings, and whether the call gave any."""
    names = schema.names

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        extract = make_extractor()
        for texts in batches:
            columns, worked = {n: [] for n in names}, []
            for one in texts:
                try:
                    found = dict(extract(one))
                    worked.append(True)
                except Exception:
                    found = {}
                    worked.append(False)
                for n, values in columns.items():
                    value = found.get(n)
                    values.append(None if value is None else str(value))
            yield pd.DataFrame({**columns, "_worked": worked}, columns=[*names, "_worked"], dtype=object)

    return F.pandas_udf(run, T.StructType([*schema.fields, T.StructField("_worked", T.BooleanType())]))


def extract_fields_stored(
    df: DataFrame,
    make_extractor: Callable[[], Callable[[str], dict]],
    store: str,
    text: str = "description",
    into: str = "extracted_data",
    schema: T.StructType = S.EXTRACTED,
    partitions: int | None = None,
    max_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add the extraction struct by the caller's function, called once for each text ever seen.

    ``store`` is a folder of results by digest of the text, made if it is not there. Distinct texts without a result there
    are extracted when this is called and their results added; a call that raises, or returns no dict, gives null fields
    and stores nothing, so that it is tried again the next time. Rows then take their result by digest: a text that
    more than ``rows_per_task`` of them share meets its result by broadcast. ``df`` is read several times: pass a stored table. A null text is not asked about and has null fields. ``partitions`` sets
    the number of parallel calls. Two runs at a time may both ask about a text; one of their results counts. The
    store belongs to one function: results of another one need another folder.
    """
    spark = df.sparkSession
    stored = T.StructType([T.StructField("_digest", T.StringType()), *schema.fields])
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    results = spark.read.schema(stored).parquet(store)
    asked = df.select(F.col(f"`{text}`").alias("_text")).filter(F.col("_text").isNotNull())
    digest = F.sha2("_text", 256)
    known = results.select(_key(F.col("_digest")).alias("_key"))
    if fits_broadcast(known, max_rows):
        new = asked.distinct().withColumn("_key", _key(digest)).join(F.broadcast(known), "_key", "left_anti")
        texts = new.select(digest.alias("_digest"), "_text")
        if results.isEmpty():
            unasked = not asked.isEmpty()
        else:
            texts = materialize(texts)
            unasked = not texts.isEmpty()
    else:
        # Keys alone are compared first, so that texts with results are not shuffled. A key of many rows is one row a task.
        new = materialize(asked.select(_key(digest).alias("_key")).distinct().join(known, "_key", "left_anti"))
        unasked = not new.isEmpty()
        if unasked:
            found = asked.withColumn("_key", _key(digest))
            found = keyed_join(found, new, ["_key"], max_rows=max_rows)
            texts = found.select("_text").distinct().select(digest.alias("_digest"), "_text")
    if unasked:
        told = extract_texts(texts, make_extractor, schema, partitions)
        told.filter("_told._worked").select("_digest", *[F.col(f"_told.`{n}`").alias(n) for n in schema.names]).write.mode("append").option("compression", "zstd").parquet(store)
        results = spark.read.schema(stored).parquet(store)
    fields = F.struct(*[F.col(f"`{n}`") for n in schema.names]).alias("_found")
    known = results.select(_key(F.col("_digest")).alias("_key"), fields).groupBy("_key").agg(F.min("_found").alias("_found"))
    rows = df.withColumn("_key", _key(F.sha2(F.col(f"`{text}`"), 256)))
    if fits_broadcast(results, max_rows):
        joined = rows.join(F.broadcast(known), "_key", "left")
    else:
        joined = _with_results(rows, known, rows_per_task)
    found = F.struct(*[F.col(f"_found.`{n}`").alias(n) for n in schema.names])
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != into], found.alias(into))


def _key(digest: Column) -> Column:
    """The digest's bytes, which shuffle in half the size of its digits."""
    return F.unhex(digest)


def _with_results(rows: DataFrame, known: DataFrame, rows_per_task: int) -> DataFrame:
    """Rows with the results of their keys; ``known`` has a key once.

    Rows whose key is shared by more than ``rows_per_task`` rows meet its result by broadcast, the others by one shuffle of
    each side. Candidates are told from counts by a hash of the key, which shuffle little, and counted exactly if there are any.
    """
    bucket = F.pmod(F.xxhash64("_key"), F.lit(KEY_BUCKETS))
    many = lambda counted, by: counted.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_task)
    keyed = rows.select("_key").filter(F.col("_key").isNotNull()).withColumn("_bucket", bucket)
    buckets = materialize(many(keyed, "_bucket").select("_bucket"))
    plain = lambda some: some.join(known, "_key", "left")
    if buckets.isEmpty():
        return plain(rows)
    hot = materialize(many(keyed.join(F.broadcast(buckets), "_bucket"), "_key").select("_key"))
    if hot.isEmpty():
        return plain(rows)
    shared = materialize(known.join(F.broadcast(hot), "_key"))
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    marked = rows.join(marked, "_key", "left")
    cold, often = marked.filter(F.col("_hot").isNull()).drop("_hot"), marked.filter("_hot").drop("_hot")
    return plain(cold).unionByName(often.join(F.broadcast(shared), "_key", "left"))


def extract_texts(texts: DataFrame, make_extractor: Callable[[], Callable[[str], dict]], schema: T.StructType, partitions: int | None) -> DataFrame:
    """Texts by digest with what the caller's function tells of each."""
    rows = texts if partitions is None else texts.repartition(partitions)
    # Not deterministic, so that no plan calls it a second time to filter by what it tells.
    return rows.withColumn("_told", _caller(make_extractor, schema).asNondeterministic()("_text"))


def _filled(df: DataFrame, extracted: str, legacy_string: bool) -> dict[str, Column]:
    """Each column as the merge leaves it."""
    read = df.schema[extracted].dataType
    types = {f.name: T.StringType() if legacy_string else f.dataType for f in df.schema if f.name in read.names}
    return {c: F.coalesce(F.col(f"`{c}`").cast(t), F.col(f"`{extracted}`")[c].try_cast(t)) for c, t in types.items()}


def merge_extracted(
    df: DataFrame,
    extracted: str = "extracted_data",
    drop: tuple[str, ...] = ("description", "id"),
    legacy_string: bool = False,
    counted: Observation | None = None,
) -> DataFrame:
    """Fill nulls of the listing columns from the extraction struct; present values always win.

    Columns keep their order and type; text that is no number fills nothing.
    ``legacy_string`` turns every fillable column into a string instead. ``counted`` gets the null cells before and
    after, of the columns that remain, when the result is written (``observed_report``).
    """
    if counted is None:
        return df.withColumns(_filled(df, extracted, legacy_string)).drop(extracted, *drop)
    counts = _with_counts(df, extracted, drop, legacy_string, True)
    sums = [F.coalesce(F.sum(f"_{c}"), F.lit(0).cast("long")).alias(f"{c}_nulls") for c in ("initial", "final")]
    kept = [c for c in df.columns if c != extracted and c not in drop]
    return counts.observe(counted, *sums).select(*[F.col(f"_after.`{c}`").alias(c) for c in kept])


def merge_report(
    df: DataFrame,
    extracted: str = "extracted_data",
    drop: tuple[str, ...] = ("description", "id"),
    legacy_string: bool = False,
    same_columns: bool = True,
) -> DataFrame:
    """What ``merge_extracted`` would recover, as ``recovery_report`` tells it, from one scan of the unmerged rows."""
    counts = _with_counts(df, extracted, drop, legacy_string, same_columns)
    return counted_report(counts.select(F.col("_initial").alias("initial"), F.col("_final").alias("final")))


def _with_counts(df: DataFrame, extracted: str, drop: tuple[str, ...], legacy_string: bool, same_columns: bool) -> DataFrame:
    """Rows after the merge, as a struct, with their missing cells before and after it."""
    filled = _filled(df, extracted, legacy_string)
    fields = [f for f in df.schema if f.name != extracted and f.name not in drop]
    after = df.select("*", F.struct(*[filled.get(f.name, F.col(f"`{f.name}`")).alias(f.name) for f in fields]).alias("_after"))
    listed = fields if same_columns else [f for f in df.schema if f.name != extracted]
    before = missing_cells([(F.col(f"`{f.name}`"), f.dataType) for f in listed])
    left = missing_cells([(F.col(f"_after.`{f.name}`"), f.dataType) for f in after.schema["_after"].dataType])
    return after.select("_after", before.alias("_initial"), left.alias("_final"))
