"""Queries over the derived listings: sources, preparation, model names, enrichment."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import schemas as S
from forecourt.operators import enrich, models, prepare, quality
from forecourt.plans import refine
from forecourt.plans.joins import materialize, shared_folder
from forecourt.sources import files, tables
from forecourt.workload.registry import query
from forecourt.workload.views import LISTINGS_SQL, PRICE_LIST_SQL, listings, price_list, table

_VALID = "price <> 0 AND price IS NOT NULL AND year IS NOT NULL AND model IS NOT NULL AND odometer IS NOT NULL"
_MAKERS = "manufacturer IN ('ford', 'toyota', 'chevrolet', 'honda')"


def _scratch(spark) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _schema_name() -> str:
    """A schema of this run alone."""
    return f"market_{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------

@query(f"""WITH {LISTINGS_SQL}
SELECT id, price, year, manufacturer, model, odometer, description FROM listings""")
def csv_round_trip(spark, sf_dir):
    path = _scratch(spark)
    raw = listings(spark, sf_dir)
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in S.LISTING if f.name not in raw.columns]
    files.write_csv(raw.select("*", *absent).select(*S.LISTING.names), path)
    return files.read_listings(spark, path).select(
        "id", "price", "year", "manufacturer", "model", "odometer", "description"
    )


@query(f"""WITH {LISTINGS_SQL}
SELECT id, manufacturer, model, price FROM listings WHERE {_VALID}""")
def table_round_trip(spark, sf_dir):
    schema = _schema_name()
    tables.ensure_schema(spark, schema)
    name = f"{schema}.vehicles_cleaned"
    cleaned = prepare.filter_valid(listings(spark, sf_dir))
    tables.write_table(cleaned, name, path=_scratch(spark))
    return tables.read_table(spark, name).select("id", "manufacturer", "model", "price")


# --- preparation -------------------------------------------------------------

_KEPT = ["id", "price", "year", "manufacturer", "model", "condition", "cylinders", "fuel", "odometer", "transmission",
         "drive", "type", "paint_color", "description"]


@query(f"WITH {LISTINGS_SQL} SELECT {', '.join(_KEPT)} FROM listings WHERE {_MAKERS} AND {_VALID}")
def clean_listings(spark, sf_dir):
    return refine.silver(listings(spark, sf_dir), fraction=1.0, key=["id"]).select(*_KEPT)


@query("""SELECT event_id, user_id, event_type, value FROM events
WHERE substr(md5(CAST(event_id AS VARCHAR)), 1, 8) < printf('%08x', CAST(floor(0.01 * 4294967296) AS BIGINT))""")
def hash_sample(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return prepare.sample_rows(events, 0.01, key=["event_id"])


@query("SELECT true AS all_drawn_from_the_table, true AS none_twice, true AS share_within_bounds")
def random_sample(spark, sf_dir):
    """What holds of any random sample of distinct rows: five standard deviations bound its share."""
    rows = materialize(listings(spark, sf_dir).select("id", "manufacturer").withColumn("row", F.monotonically_increasing_id()))
    drawn = prepare.sample_rows(rows, 0.1, seed=7)
    counted = rows.join(drawn.groupBy("row").agg(F.count("*").alias("times")), "row", "left")
    n, some = F.count("*"), F.count("times")
    return counted.agg(
        (some <= n).alias("all_drawn_from_the_table"),
        (F.coalesce(F.max("times"), F.lit(1)) == 1).alias("none_twice"),
        (F.abs(some - 0.1 * n) <= 5 * F.sqrt(0.09 * n)).alias("share_within_bounds"),
    )


@query(f"""WITH {LISTINGS_SQL}
SELECT 0 AS position, 'raw' AS stage, count(*) AS n_rows FROM listings
UNION ALL SELECT 1, 'manufacturers', count(*) FROM listings WHERE {_MAKERS}
UNION ALL SELECT 2, 'valid', count(*) FROM listings WHERE {_MAKERS} AND {_VALID}""")
def stage_counts(spark, sf_dir):
    stages = {
        "raw": F.lit(True),
        "manufacturers": F.col("manufacturer").isin(S.TARGET_MANUFACTURERS),
        "valid": prepare.is_valid(),
    }
    return prepare.stage_counts(listings(spark, sf_dir), stages)


# --- model names -------------------------------------------------------------

@query(f"""WITH {LISTINGS_SQL}
SELECT DISTINCT manufacturer, model FROM listings WHERE manufacturer IS NOT NULL AND model IS NOT NULL""")
def distinct_models(spark, sf_dir):
    return models.distinct_models(listings(spark, sf_dir))


@query(f"""WITH {LISTINGS_SQL}
SELECT manufacturer, model, count(*) AS n FROM listings
WHERE manufacturer IS NOT NULL AND model IS NOT NULL GROUP BY ALL""")
def model_counts(spark, sf_dir):
    return models.model_counts(listings(spark, sf_dir))


_PROPOSED_SQL = """
proposed AS (
  SELECT manufacturer, canonical, n,
    CAST(row_number() OVER (PARTITION BY manufacturer ORDER BY length(canonical) DESC, n DESC, canonical) - 1 AS INT) AS pos
  FROM (
    SELECT manufacturer, split_part(lower(model), ' ', 1) AS canonical, count(*) AS n FROM listings
    WHERE manufacturer IS NOT NULL AND model IS NOT NULL GROUP BY ALL
  )
  WHERE n >= 2 AND canonical <> ''
)"""


@query(f"WITH {LISTINGS_SQL}, {_PROPOSED_SQL} SELECT manufacturer, pos, canonical, n FROM proposed")
def propose_dictionary(spark, sf_dir):
    return models.propose_dictionary(listings(spark, sf_dir))


@query(f"""WITH {LISTINGS_SQL},
names AS (SELECT manufacturer, string_split_regex(trim(lower(model)), '\\s+') AS words, count(*) AS n FROM listings
  WHERE manufacturer IS NOT NULL AND trim(model) <> '' GROUP BY ALL),
begun AS (SELECT manufacturer, n, words[1:length] AS beginning, words[length + 1] AS next, length = least(len(words), 4) AS whole
  FROM (SELECT *, unnest(range(1, least(len(words), 4) + 1)) AS length FROM names)),
ways AS (SELECT manufacturer, beginning, next, sum(n) AS n, max(whole) AS whole FROM begun GROUP BY ALL),
tree AS (SELECT manufacturer, beginning, sum(n) AS n, max(whole) AS whole, max(n) <= 0.9 * sum(n) AND count(*) > 1 AS branches FROM ways GROUP BY ALL)
SELECT manufacturer, CAST(1000000 - length(array_to_string(beginning, ' ')) AS INT) AS pos, array_to_string(beginning, ' ') AS canonical, CAST(n AS BIGINT) AS n
FROM tree t WHERE n >= 2 AND (branches OR whole) AND NOT EXISTS (
  SELECT 1 FROM tree s WHERE s.manufacturer = t.manufacturer AND s.branches AND len(s.beginning) < len(t.beginning)
    AND s.beginning = t.beginning[1:len(s.beginning)])""")
def propose_base_names(spark, sf_dir):
    return models.propose_base_names(listings(spark, sf_dir))


_NAMES = {
    "ford": ["red ring", "Ring", "small", "old gear", "gear"],
    "toyota": ["cold", "hot rod", "rod"],
    "honda": ["plate", "new"],
}


def _nested_case(maker: str) -> str:
    value = "model"
    for name in _NAMES[maker]:
        value = f"CASE WHEN contains(lower({value}), '{name.lower()}') THEN '{name}' ELSE {value} END"
    return f"WHEN '{maker}' THEN {value}"


@query(f"""WITH {LISTINGS_SQL}
SELECT id, manufacturer, CASE manufacturer {' '.join(_nested_case(m) for m in _NAMES)} ELSE model END AS model FROM listings""")
def normalize_models(spark, sf_dir):
    names = models.dictionary_frame(spark, _NAMES)
    return models.normalize_models(listings(spark, sf_dir), names).select("id", "manufacturer", "model")


_PATTERNS = {"ford": ["^r.d", "ring$"], "kia": ["(hot|cold) (bolt|rod)"]}


@query(f"""WITH {LISTINGS_SQL}
SELECT id, manufacturer, CASE
  WHEN manufacturer = 'ford' AND regexp_matches(model, '^r.d', 'i') THEN '^r.d'
  WHEN manufacturer = 'ford' AND regexp_matches(model, 'ring$', 'i') THEN 'ring$'
  WHEN manufacturer = 'kia' AND regexp_matches(model, '(hot|cold) (bolt|rod)', 'i') THEN '(hot|cold) (bolt|rod)'
  ELSE model END AS model FROM listings""")
def normalize_models_regex(spark, sf_dir):
    names = models.dictionary_frame(spark, _PATTERNS)
    return models.normalize_models(listings(spark, sf_dir), names, mode="regex").select("id", "manufacturer", "model")


# --- enrichment --------------------------------------------------------------

def _rule_sql(name: str) -> str:
    pattern, group = enrich.RULES[name]
    found = f"regexp_extract(lower(description), '{pattern}', {group})"
    if name in enrich.NUMBERS:
        found = f"replace({found}, ',', '')"
    return f"nullif({found}, '')"


_EXTRACTED_SQL = ", ".join(f"{_rule_sql(n)} AS {n}" for n in S.EXTRACTED_FIELDS)


@query(f"WITH {LISTINGS_SQL} SELECT id, {_EXTRACTED_SQL} FROM listings")
def extract_fields_rules(spark, sf_dir):
    return enrich.extract_fields_rules(listings(spark, sf_dir)).select("id", "extracted_data.*")


_PAGE_RULES = {
    "lang": (r'<html lang="([a-z]+)"', 1),
    "title": (r"<title>([^<]*)</title>", 1),
    "charset": (r'charset="([^"]*)"', 1),
}


@query("SELECT page_id, " + ", ".join(
    f"nullif(regexp_extract(lower(html), '{p}', {g}), '') AS {n}" for n, (p, g) in _PAGE_RULES.items()
) + " FROM pages")
def extract_page_fields(spark, sf_dir):
    pages = enrich.extract_fields_rules(table(spark, sf_dir, "pages"), "html", rules=_PAGE_RULES, numbers=())
    return pages.select("page_id", "extracted_data.*")


def _regex_extractor(rules, numbers):
    def make():
        import re

        compiled = {n: (re.compile(p), g) for n, (p, g) in rules.items()}

        def extract(text):
            low, found = text.lower(), {}
            for name, (pattern, group) in compiled.items():
                match = pattern.search(low)
                if match:
                    found[name] = match.group(group).replace(",", "") if name in numbers else match.group(group)
            return found

        return extract

    return make


@query(f"WITH {LISTINGS_SQL} SELECT id, {_EXTRACTED_SQL} FROM listings")
def extract_fields_udf(spark, sf_dir):
    make = _regex_extractor(enrich.RULES, enrich.NUMBERS)
    return enrich.extract_fields_udf(listings(spark, sf_dir), make).select("id", "extracted_data.*")


def _never():
    def extract(text):
        raise AssertionError("asked again")

    return extract


@query(f"WITH {LISTINGS_SQL} SELECT id, {_EXTRACTED_SQL} FROM listings")
def extract_fields_stored(spark, sf_dir):
    """The second run finds all results stored: a call would give nulls."""
    cars, store = materialize(listings(spark, sf_dir).select("id", "description")), _scratch(spark)
    enrich.extract_fields_stored(cars, _regex_extractor(enrich.RULES, enrich.NUMBERS), store)
    return enrich.extract_fields_stored(cars, _never, store).select("id", "extracted_data.*")


@query("""WITH told AS (
  SELECT event_id AS id, user_id % 100000 AS miles, CASE WHEN event_id % 50 = 0 THEN 'none' ELSE CAST(event_id % 30 + 1990 AS VARCHAR) END AS year,
    event_id % 70 = 1 AS short FROM events)
SELECT 'row' AS kind, count(*) AS n FROM told WHERE year <> 'none' AND NOT short
UNION ALL SELECT CASE WHEN year = 'none' THEN 'year' ELSE 'number of fields' END, count(*) FROM told WHERE year = 'none' OR short GROUP BY ALL""")
def quarantined_records(spark, sf_dir):
    """Records of events written as lines, some of them broken."""
    c, path = F.col, _scratch(spark)
    year = F.when(c("event_id") % 50 == 0, "none").otherwise((c("event_id") % 30 + 1990).cast("string"))
    line = F.concat_ws(",", c("event_id"), F.when(c("event_id") % 70 != 1, c("user_id") % 100000), year)
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    rows, bad = files.read_with_quarantine(spark, path, _EVENT_LINE, multi_line=False, header=False)
    return rows.select(F.lit("row").alias("kind")).unionByName(bad.select(F.col("reason").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


_EVENT_LINE = T.StructType([T.StructField("id", T.LongType()), T.StructField("miles", T.LongType()), T.StructField("year", T.IntegerType())])


def _filled(name: str, sql_type: str) -> str:
    return f"coalesce({name}, TRY_CAST({_rule_sql(name)} AS {sql_type})) AS {name}"


_MERGED_SQL = ", ".join([
    _filled("manufacturer", "VARCHAR"), _filled("model", "VARCHAR"), _filled("year", "INT"), _filled("price", "DOUBLE"),
    _filled("odometer", "INT"), _filled("condition", "VARCHAR"), _filled("fuel", "VARCHAR"),
    _filled("transmission", "VARCHAR"), _filled("drive", "VARCHAR"), _filled("type", "VARCHAR"),
    _filled("paint_color", "VARCHAR"), "cylinders", "url", "title_status",
])


@query(f"WITH {LISTINGS_SQL} SELECT {_MERGED_SQL} FROM listings")
def merge_extracted(spark, sf_dir):
    return enrich.merge_extracted(enrich.extract_fields_rules(listings(spark, sf_dir)))


_FILLABLE = [c for c in _KEPT if c in S.EXTRACTED_FIELDS]


@query(f"""WITH {LISTINGS_SQL}, named AS (
  SELECT * REPLACE (CASE manufacturer {' '.join(_nested_case(m) for m in _NAMES)} ELSE model END AS model)
  FROM listings WHERE {_MAKERS} AND {_VALID}
)
SELECT manufacturer, model, year, price, odometer, cylinders,
  {', '.join(_filled(c, 'VARCHAR') for c in ('condition', 'fuel', 'transmission', 'drive', 'type', 'paint_color'))}
FROM named""")
def gold_listings(spark, sf_dir):
    cleaned = refine.silver(listings(spark, sf_dir), fraction=1.0, key=["id"])
    return refine.gold(cleaned, models.dictionary_frame(spark, _NAMES))


def _null_sql(view: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS n_nulls, count(*) AS n_rows FROM {view}" for c in columns
    )


_ALL = [*_KEPT, "url", "title_status"]


@query(f"WITH {LISTINGS_SQL} {_null_sql('listings', _ALL)}")
def null_profile(spark, sf_dir):
    return quality.null_profile(listings(spark, sf_dir))


_AFTER = [c for c in _ALL if c not in ("id", "description")]


def _report_sql(before: list[str]) -> str:
    return f"""WITH {LISTINGS_SQL}, merged AS (SELECT {_MERGED_SQL} FROM listings),
sums AS (SELECT (SELECT sum(n_nulls) FROM ({_null_sql('listings', before)})) AS a,
  (SELECT sum(n_nulls) FROM ({_null_sql('merged', _AFTER)})) AS b)
SELECT a AS initial_nulls, b AS final_nulls, a - b AS recovered, coalesce(round((a - b) / nullif(a, 0) * 100, 2), 0) AS percentage
FROM sums"""


@query(_report_sql(_AFTER))
def recovery_report(spark, sf_dir):
    return enrich.merge_report(enrich.extract_fields_rules(listings(spark, sf_dir)))


@query(_report_sql(_AFTER))
def recovery_report_of_two_tables(spark, sf_dir):
    before = materialize(listings(spark, sf_dir))
    return quality.recovery_report(before, enrich.merge_extracted(enrich.extract_fields_rules(before)))


@query(_report_sql(_ALL))
def recovery_report_all_columns(spark, sf_dir):
    return enrich.merge_report(enrich.extract_fields_rules(listings(spark, sf_dir)), same_columns=False)


# --- the whole chain ---------------------------------------------------------

def _refreshed(spark, sf_dir):
    """Bronze to gold from the two CSV sources, in a schema of this run: (schema, report)."""
    folder, schema = _scratch(spark), _schema_name()
    raw = listings(spark, sf_dir)
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in S.LISTING if f.name not in raw.columns]
    files.write_csv(raw.select("*", *absent).select(*S.LISTING.names), f"{folder}/listings")
    prices = price_list(spark, sf_dir).select("component", "diagnostic", F.col("reparation_cost").cast("int").alias("reparation_cost"))
    files.write_csv(prices, f"{folder}/prices")
    names = models.dictionary_frame(spark, _NAMES)
    extract = lambda df: enrich.extract_fields_udf(df, _regex_extractor(enrich.RULES, enrich.NUMBERS))
    report = refine.refresh_tables(spark, schema, f"{folder}/listings", f"{folder}/prices", names, extract, key=["id"])
    return schema, report


_CHAIN_GOLD_SQL = f"""named AS (
  SELECT * REPLACE (CASE manufacturer {' '.join(_nested_case(m) for m in _NAMES)} ELSE model END AS model)
  FROM listings WHERE {_MAKERS} AND {_VALID}
), gold AS (
  SELECT manufacturer, model, year, price, odometer, cylinders,
  {', '.join(_filled(c, 'VARCHAR') for c in ('condition', 'fuel', 'transmission', 'drive', 'type', 'paint_color'))} FROM named
)"""


@query(f"WITH {LISTINGS_SQL}, {_CHAIN_GOLD_SQL} SELECT * FROM gold")
def refreshed_gold(spark, sf_dir):
    schema, _ = _refreshed(spark, sf_dir)
    gold = tables.read_table(spark, f"{schema}.{refine.ENRICHED}")
    return gold.select("manufacturer", "model", "year", "price", "odometer", "cylinders", "condition", "fuel", "transmission", "drive", "type", "paint_color")


@query(f"WITH {PRICE_LIST_SQL} SELECT component, diagnostic, reparation_cost FROM price_list")
def refreshed_price_list(spark, sf_dir):
    schema, _ = _refreshed(spark, sf_dir)
    return tables.read_table(spark, f"{schema}.{refine.REPAIRS}")


_CHAIN_COLUMNS = ["condition", "fuel", "transmission", "drive", "type", "paint_color", "manufacturer", "model", "year", "price", "odometer", "cylinders"]


@query(f"""WITH {LISTINGS_SQL}, {_CHAIN_GOLD_SQL},
sums AS (SELECT (SELECT sum(n_nulls) FROM ({_null_sql('named', _CHAIN_COLUMNS)})) AS a,
  (SELECT sum(n_nulls) FROM ({_null_sql('gold', _CHAIN_COLUMNS)})) AS b)
SELECT a AS initial_nulls, b AS final_nulls, a - b AS recovered, coalesce(round((a - b) / nullif(a, 0) * 100, 2), 0) AS percentage FROM sums""")
def refreshed_report(spark, sf_dir):
    return _refreshed(spark, sf_dir)[1]
