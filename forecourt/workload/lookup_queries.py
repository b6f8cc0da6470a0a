"""Queries over listings, requests and the price list: market, repair, advice, ad-hoc SQL."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.operators import adhoc, advise as advice, market, repair
from forecourt.plans.joins import materialize, shared_folder
from forecourt.sources.tables import write_by_maker
from forecourt.workload.registry import query
from forecourt.workload.views import LISTINGS_SQL, PRICE_LIST_SQL, REQUESTS_SQL, listings, price_list, request_name, requests, table


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Four decimals; the small addend keeps exact halves on one side in every engine."""
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c) + 1e-7, 4))
    return df


def _round_sql(expression: str, name: str) -> str:
    return f"round({expression} + 1e-7, 4) AS {name}"


_STATS_SQL = f"""{_round_sql('avg(price)', 'average_price')}, quantile_disc(price, 0.5) AS median_price,
  {_round_sql('stddev_samp(price)', 'price_std_dev')}, count(*) AS num_cars_sold"""

_HINT_SQL = "CASE WHEN {n} = 0 THEN 'no comparable sale: drop the condition, widen the years or shorten the model name' END AS hint"


def _sold(spark, sf_dir) -> DataFrame:
    """The columns of the listings that the lookup reads several times, joined once."""
    return materialize(
        listings(spark, sf_dir).select("manufacturer", "model", "condition", "year", "odometer", "price")
    )


# --- market ------------------------------------------------------------------

@query(f"""WITH {LISTINGS_SQL}
SELECT id, manufacturer, model, year, condition, odometer, price FROM listings
WHERE price > 0 AND lower(manufacturer) LIKE '%rover%' AND lower(model) LIKE '%ring%'
  AND year BETWEEN 1997 AND 1999 AND lower(condition) LIKE '%new%' AND odometer BETWEEN 30000 AND 70000""")
def comparables(spark, sf_dir):
    found = market.comparables(listings(spark, sf_dir), "Rover", "ring", 1998, "NEW", 50000)
    return found.select("id", "manufacturer", "model", "year", "condition", "odometer", "price")


@query(f"""WITH {LISTINGS_SQL}
SELECT id, manufacturer, model, price FROM listings WHERE price > 0 AND manufacturer ILIKE '%m%z%' AND model ILIKE '%r_d%'""")
def comparables_wildcards(spark, sf_dir):
    found = market.comparables(listings(spark, sf_dir), "m%z", "r_d", like_wildcards=True)
    return found.select("id", "manufacturer", "model", "price")


@query(f"""WITH {LISTINGS_SQL}
SELECT id, manufacturer, model, price FROM listings WHERE price > 0 AND lower(manufacturer) LIKE '%ford%' AND lower(fuel) LIKE '%gas%'
  AND lower(drive) LIKE '%fwd%' AND lower(paint_color) LIKE '%red%' AND lower(cylinders) LIKE '%4%'""")
def comparables_all_fields(spark, sf_dir):
    found = market.comparables(listings(spark, sf_dir), "Ford", fuel="GAS", drive="fwd", paint_color="red", cylinders=4, car_type=None)
    return found.select("id", "manufacturer", "model", "price")


@query(f"""WITH {LISTINGS_SQL}
SELECT {_STATS_SQL}, count(*) > 0 AS found, {_HINT_SQL.format(n='count(*)')} FROM listings
WHERE price > 0 AND lower(manufacturer) LIKE '%toyota%' AND lower(model) LIKE '%widget%' AND year BETWEEN 1996 AND 1998""")
def market_stats(spark, sf_dir):
    found = market.market_stats(market.comparables(listings(spark, sf_dir), "Toyota", "widget", 1997))
    return _rounded(found, "average_price", "price_std_dev")


@query(f"""WITH {LISTINGS_SQL}
SELECT manufacturer, {_STATS_SQL}, count(*) > 0 AS found, {_HINT_SQL.format(n='count(*)')} FROM listings WHERE price > 0 GROUP BY manufacturer""")
def market_stats_by_manufacturer(spark, sf_dir):
    found = market.market_stats(market.comparables(listings(spark, sf_dir)), by=("manufacturer",))
    return _rounded(found, "average_price", "price_std_dev")


@query(f"""WITH {LISTINGS_SQL}
SELECT {_STATS_SQL}, count(*) > 0 AS found, {_HINT_SQL.format(n='count(*)')} FROM listings WHERE price > 0 AND lower(manufacturer) LIKE '%no such maker%'""")
def market_stats_not_found(spark, sf_dir):
    found = market.market_stats(market.comparables(listings(spark, sf_dir), "no such maker"))
    return _rounded(found, "average_price", "price_std_dev")


_PAIRS_SQL = """
wanted AS (
  SELECT *, 0 AS up FROM requests
  UNION ALL SELECT * REPLACE (split_part(trim(model), ' ', 1) AS model), 5 FROM requests WHERE contains(trim(model), ' ')
),
pairs AS (
  SELECT r.request_id, l.price, up + CASE
    WHEN coalesce(r.odometer, 0) <> 0 AND NOT coalesce(abs(l.odometer - r.odometer) <= 20000, false) THEN 4
    WHEN coalesce(r.year, 0) <> 0 AND NOT coalesce(abs(l.year - r.year) <= 3, false) THEN 3
    WHEN coalesce(r.year, 0) <> 0 AND NOT coalesce(abs(l.year - r.year) <= 1, false) THEN 2
    WHEN coalesce(r.condition, '') <> '' AND NOT coalesce(contains(lower(l.condition), lower(r.condition)), false) THEN 1
    ELSE 0 END AS tier
  FROM wanted r JOIN listings l ON l.price > 0
    AND (coalesce(r.manufacturer, '') = '' OR contains(lower(l.manufacturer), lower(r.manufacturer)))
    AND (coalesce(r.model, '') = '' OR contains(lower(l.model), lower(r.model)))
),
first_rung AS (SELECT request_id, min(tier) AS tier FROM pairs GROUP BY request_id),
figures AS (
  SELECT request_id, tier, avg(price) AS mean, quantile_disc(price, 0.5) AS median, stddev_samp(price) AS deviation,
    count(*) AS n
  FROM pairs JOIN first_rung USING (request_id, tier) GROUP BY ALL
)"""


_ESTIMATE_SQL = f"""WITH {LISTINGS_SQL}, {REQUESTS_SQL}, {_PAIRS_SQL}
SELECT request_id, tier AS relax_tier, {_round_sql('mean', 'average_price')}, median AS median_price,
  {_round_sql('deviation', 'price_std_dev')}, coalesce(n, 0) AS num_cars_sold, coalesce(n, 0) > 0 AS found,
  {_HINT_SQL.format(n='coalesce(n, 0)')}
FROM requests LEFT JOIN figures USING (request_id)"""


@query(_ESTIMATE_SQL)
def market_estimate(spark, sf_dir):
    found = market.market_estimate(requests(spark, sf_dir), _sold(spark, sf_dir))
    return _rounded(found, "average_price", "price_std_dev")


def _by_maker(spark, sf_dir, *columns: str) -> DataFrame:
    """Listings as a table with a folder for each maker."""
    folder, name = f"{shared_folder(spark)}/{uuid.uuid4().hex}", f"by_maker_{uuid.uuid4().hex}"
    write_by_maker(listings(spark, sf_dir).select(*columns), name, path=folder)
    stored = spark.read.option("basePath", folder).schema(spark.table(name).schema).parquet(folder)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return stored


@query(_ESTIMATE_SQL + " WHERE contains(lower(manufacturer), 'rd') OR contains(lower(manufacturer), 'me')")
def market_estimate_by_maker(spark, sf_dir):
    """Only folders of the makers that these requests are about are read."""
    name = F.lower("manufacturer")
    asked = requests(spark, sf_dir).filter(name.contains("rd") | name.contains("me"))
    sold = _by_maker(spark, sf_dir, "manufacturer", "model", "condition", "year", "odometer", "price")
    return _rounded(market.market_estimate(asked, sold), "average_price", "price_std_dev")


@query(f"""WITH {LISTINGS_SQL}
SELECT id, manufacturer, model, year, price FROM listings WHERE price > 0 AND contains(lower(manufacturer), 'rover') AND year BETWEEN 1996 AND 1998""")
def comparables_by_maker(spark, sf_dir):
    found = market.comparables(_by_maker(spark, sf_dir, "id", "manufacturer", "model", "year", "price"), "Rover", year=1997)
    return found.select("id", "manufacturer", "model", "year", "price")


# --- repair ------------------------------------------------------------------

_TERMS_SQL = """
asked AS (
  SELECT request_id, list_transform(
    list_concat(coalesce(components, []), CASE WHEN coalesce(diagnosis, '') <> '' THEN [diagnosis] ELSE [] END),
    lambda t: lower(trim(t))) AS terms
  FROM requests
),
own AS (SELECT request_id, unnest(terms) AS term FROM asked),
words AS (
  SELECT DISTINCT request_id, word AS term
  FROM (SELECT request_id, unnest(string_split_regex(term, '\\s+')) AS word FROM own) WHERE length(word) >= 4
),
hits AS (
  SELECT DISTINCT p.request_id, p.tier, c.rid FROM (
    SELECT request_id, 0 AS tier, term FROM own UNION ALL SELECT request_id, 1, term FROM words
  ) p JOIN numbered c ON contains(lower(c.component), p.term) OR contains(lower(c.diagnostic), p.term)
  UNION ALL SELECT a.request_id, 0, c.rid FROM asked a, numbered c WHERE len(a.terms) = 0
)"""

_NUMBERED_SQL = "numbered AS (SELECT *, row_number() OVER () AS rid FROM price_list)"


@query(f"""WITH {PRICE_LIST_SQL}
SELECT component, diagnostic, reparation_cost FROM price_list
WHERE lower(component) LIKE '%ring%' OR lower(diagnostic) LIKE '%ring%' OR lower(component) LIKE '%promo noise%'
  OR lower(diagnostic) LIKE '%promo noise%'""")
def repairs_for(spark, sf_dir):
    return repair.repairs_for(price_list(spark, sf_dir), "PROMO noise", [" Ring "])


@query(f"""WITH {PRICE_LIST_SQL} SELECT component, diagnostic, reparation_cost FROM price_list""")
def repairs_for_nothing(spark, sf_dir):
    return repair.repairs_for(price_list(spark, sf_dir))


_SETS_SQL = """
named_sets AS (SELECT request_id, array_to_string(list_sort(list_distinct(terms)), '; ') AS term_set FROM asked),
sets AS (SELECT term_set, min(request_id) AS request_id FROM named_sets GROUP BY term_set)"""


@query(f"WITH {REQUESTS_SQL}, {PRICE_LIST_SQL}, {_NUMBERED_SQL}, {_TERMS_SQL}, {_SETS_SQL} SELECT request_id, term_set FROM named_sets")
def request_term_sets(spark, sf_dir):
    return repair.request_term_sets(requests(spark, sf_dir))


@query(f"""WITH {REQUESTS_SQL}, {PRICE_LIST_SQL}, {_NUMBERED_SQL}, {_TERMS_SQL}, {_SETS_SQL}
SELECT term_set, 0 AS relax_tier, component, diagnostic, reparation_cost, count(*) AS copies
FROM sets JOIN hits USING (request_id) JOIN numbered USING (rid) WHERE tier = 0 GROUP BY ALL""")
def match_repairs(spark, sf_dir):
    return repair.match_repairs(requests(spark, sf_dir), price_list(spark, sf_dir))


@query(f"""WITH {REQUESTS_SQL}, {PRICE_LIST_SQL},
sets AS (SELECT DISTINCT coalesce(lower(trim(model)), '') AS term_set FROM requests)
SELECT term_set, 0 AS relax_tier, component, diagnostic, reparation_cost, count(*) AS copies
FROM sets JOIN price_list ON term_set = '' OR contains(lower(component), term_set) OR contains(lower(diagnostic), term_set) GROUP BY ALL""")
def match_repairs_of_one_component(spark, sf_dir):
    asked = requests(spark, sf_dir).select(
        "request_id", F.lit("").alias("diagnosis"), F.concat(F.lit(" "), F.upper("model")).alias("components")
    )
    return repair.match_repairs(asked, price_list(spark, sf_dir))


@query(f"""WITH {REQUESTS_SQL}, {PRICE_LIST_SQL}, {_NUMBERED_SQL}, {_TERMS_SQL}, {_SETS_SQL},
best AS (SELECT request_id, min(tier) AS tier FROM hits GROUP BY request_id),
figures AS (
  SELECT request_id, tier, CAST(sum(coalesce(reparation_cost, 0)) AS DOUBLE) AS total, count(*) AS n
  FROM hits JOIN best USING (request_id, tier) JOIN numbered USING (rid) GROUP BY ALL
)
SELECT request_id, term_set, tier AS relax_tier, total AS total_estimated_cost, coalesce(n, 0) AS num_repairs
FROM requests JOIN named_sets USING (request_id) LEFT JOIN figures USING (request_id)""")
def repair_estimate(spark, sf_dir):
    return repair.repair_estimate(requests(spark, sf_dir), price_list(spark, sf_dir))


_DEFECTS_SQL = """
defects AS (
  SELECT request_id, lower(trim(said)) AS term FROM (
    SELECT s_suppkey AS request_id, unnest([noun || ' squeaks ' || split_part(full_name, ' ', 1) || ' noise', full_name || ' promo gear']) AS said FROM named)
),
words AS (SELECT DISTINCT request_id, term, word FROM (SELECT *, unnest(string_split_regex(term, '\\s+')) AS word FROM defects) WHERE length(word) >= 4),
vocabulary AS (SELECT DISTINCT word FROM words),
texts AS (SELECT component, diagnostic, count(*) AS n FROM price_list GROUP BY ALL),
held AS (SELECT word, component, diagnostic, n FROM vocabulary JOIN texts ON contains(lower(component), word) OR contains(lower(diagnostic), word)),
weights AS (SELECT word, greatest(CAST(round(ln(((SELECT count(*) FROM price_list) + 1.0) / sum(n)) * 1000) AS BIGINT), 1) AS weight FROM held GROUP BY word),
sums AS (SELECT request_id, term, component, diagnostic, sum(weight) AS weight
  FROM words JOIN weights USING (word) JOIN held USING (word) GROUP BY ALL),
best AS (SELECT request_id, term, max(weight) AS weight FROM sums GROUP BY ALL),
chosen AS (SELECT DISTINCT request_id, component, diagnostic FROM sums JOIN best USING (request_id, term, weight)),
defect_sets AS (SELECT request_id, array_to_string(list_sort(list(DISTINCT term)), '; ') AS term_set FROM defects GROUP BY request_id)"""


def _defects(spark, sf_dir) -> DataFrame:
    """Two defects a request, in words that no row of the price list has in this order."""
    first, noun = request_name()
    said = F.array(F.concat_ws(" ", noun, F.lit("squeaks"), first, F.lit("noise")), F.concat_ws(" ", first, noun, F.lit("promo gear")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("request_id"), F.lit("").alias("diagnosis"), said.alias("components"))


@query(f"""WITH {REQUESTS_SQL}, {PRICE_LIST_SQL}, {_DEFECTS_SQL}
SELECT DISTINCT term_set, 1 AS relax_tier, component, diagnostic, reparation_cost, count(*) OVER (PARTITION BY request_id, component, diagnostic, reparation_cost) AS copies
FROM defect_sets JOIN chosen USING (request_id) JOIN price_list USING (component, diagnostic)""")
def match_repairs_by_rarest_words(spark, sf_dir):
    return repair.match_repairs(_defects(spark, sf_dir), price_list(spark, sf_dir), min_word=4, rarest=True)


@query(f"""WITH {REQUESTS_SQL}, {PRICE_LIST_SQL}, {_DEFECTS_SQL},
figures AS (SELECT request_id, CAST(sum(coalesce(reparation_cost, 0)) AS DOUBLE) AS total, count(*) AS n
  FROM chosen JOIN price_list USING (component, diagnostic) GROUP BY request_id)
SELECT request_id, term_set, 1 AS relax_tier, total AS total_estimated_cost, n AS num_repairs FROM defect_sets JOIN figures USING (request_id)""")
def repair_estimate_by_rarest_words(spark, sf_dir):
    return repair.repair_estimate(_defects(spark, sf_dir), price_list(spark, sf_dir), rarest=True)


# --- advice ------------------------------------------------------------------

_MISSING = ("manufacturer", "model", "year", "odometer", "condition")
_MISSING_SQL = " || ".join(
    f"CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' THEN '{c} ' ELSE '' END" for c in _MISSING
)


@query(f"""WITH {REQUESTS_SQL}
SELECT request_id, trim({_MISSING_SQL}) AS missing, trim({_MISSING_SQL}) = '' AS ready FROM requests""")
def request_readiness(spark, sf_dir):
    known = advice.request_readiness(requests(spark, sf_dir))
    return known.select("request_id", F.concat_ws(" ", "missing").alias("missing"), "ready")


@query(f"""WITH {LISTINGS_SQL}, {REQUESTS_SQL}, {PRICE_LIST_SQL}, {_NUMBERED_SQL}, {_PAIRS_SQL}, {_TERMS_SQL},
known AS (SELECT request_id, trim({_MISSING_SQL}) AS missing, trim({_MISSING_SQL}) = '' AS ready FROM requests),
best AS (SELECT request_id, min(tier) AS tier FROM hits GROUP BY request_id),
costs AS (
  SELECT request_id, CAST(sum(coalesce(reparation_cost, 0)) AS DOUBLE) AS cost
  FROM hits JOIN best USING (request_id, tier) JOIN numbered USING (rid) JOIN asked USING (request_id)
  WHERE len(terms) > 0 GROUP BY request_id
),
priced AS (
  SELECT k.*, CASE WHEN ready THEN mean END AS base_value, CASE WHEN ready THEN coalesce(n, 0) END AS num_cars_sold,
    CASE WHEN ready THEN coalesce(cost, 0) END AS repair_cost, coalesce(deviation, 0) / 2 AS half,
    len(terms) > 0 AND cost IS NULL AS unpriced
  FROM known k LEFT JOIN figures USING (request_id) LEFT JOIN costs USING (request_id) LEFT JOIN asked USING (request_id)
)
SELECT request_id, ready, missing, {_round_sql('base_value', 'base_value')}, num_cars_sold, repair_cost,
  {_round_sql('base_value - repair_cost', 'list_price')},
  {_round_sql('CASE WHEN base_value IS NOT NULL THEN greatest(base_value - repair_cost - half, 0) END', 'price_low')},
  {_round_sql('CASE WHEN base_value IS NOT NULL THEN greatest(base_value - repair_cost + half, 0) END', 'price_high')},
  CASE WHEN NOT ready THEN 'ask' WHEN base_value IS NULL THEN 'no_market' WHEN unpriced THEN 'no_repair_price' WHEN repair_cost = 0 THEN 'list'
    WHEN repair_cost < 300 THEN 'fix_first' ELSE 'as_is' END AS strategy
FROM priced""")
def advise(spark, sf_dir):
    told = advice.advise(requests(spark, sf_dir), _sold(spark, sf_dir), price_list(spark, sf_dir))
    told = told.withColumn("missing", F.concat_ws(" ", "missing"))
    return _rounded(told, "base_value", "list_price", "price_low", "price_high")


# --- ad-hoc SQL --------------------------------------------------------------

_ADHOC = """
SELECT manufacturer, count(*) AS num_cars_sold, max(price) AS top_price FROM adhoc_listings
WHERE price > {least} GROUP BY manufacturer ORDER BY manufacturer"""
_BY_NAME = """
SELECT manufacturer, model, count(*) AS n FROM adhoc_listings WHERE manufacturer IS NOT NULL AND model IS NOT NULL
GROUP BY manufacturer, model ORDER BY n DESC, manufacturer, model LIMIT 120"""
_WITH_ADHOC = f"WITH {LISTINGS_SQL}, adhoc_listings AS (SELECT * FROM listings)"


def _run_adhoc(spark, sf_dir, least: int = 50000) -> DataFrame:
    listings(spark, sf_dir).createOrReplaceTempView("adhoc_listings")
    return adhoc.run_readonly_sql(spark, _ADHOC.format(least=":least") + ";", args={"least": least})


@query(f"{_WITH_ADHOC} {_ADHOC.format(least=50000)}")
def run_readonly_sql(spark, sf_dir):
    return _run_adhoc(spark, sf_dir)


@query(f"{_WITH_ADHOC} {_BY_NAME}")
def run_readonly_sql_with_limit(spark, sf_dir):
    """The limit is the text's own."""
    listings(spark, sf_dir).createOrReplaceTempView("adhoc_listings")
    return adhoc.run_readonly_sql(spark, _BY_NAME)


def _envelope(rows: DataFrame, cap: int) -> DataFrame:
    told = F.from_json("result", "found boolean, row_count long, total_rows long, truncated boolean, data array<struct<num_cars_sold:long>>")
    return adhoc.result_envelope(rows, cap).select(told.alias("t")).select(
        "t.found", "t.row_count", "t.total_rows", "t.truncated",
        F.aggregate("t.data.num_cars_sold", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
    )


@query(f"""{_WITH_ADHOC}, rows AS ({_ADHOC.format(least=50000)})
SELECT true AS found, count(*) AS row_count, count(*) AS total_rows, false AS truncated, sum(num_cars_sold) AS n FROM rows""")
def result_envelope(spark, sf_dir):
    return _envelope(_run_adhoc(spark, sf_dir), 100)


@query(f"""{_WITH_ADHOC}, rows AS ({_ADHOC.format(least=50000)}), first AS (SELECT * FROM rows ORDER BY manufacturer NULLS FIRST LIMIT 5)
SELECT true AS found, (SELECT count(*) FROM first) AS row_count, (SELECT count(*) FROM rows) AS total_rows, true AS truncated,
  (SELECT sum(num_cars_sold) FROM first) AS n""")
def result_envelope_truncated(spark, sf_dir):
    """The cap is the envelope's feature; it tells how many rows there are."""
    return _envelope(_run_adhoc(spark, sf_dir), 5)


@query(f"""{_WITH_ADHOC}, rows AS ({_ADHOC.format(least=10**12)})
SELECT count(*) > 0 AS found, CAST(NULL AS BIGINT) AS row_count, CAST(NULL AS BIGINT) AS total_rows, CAST(NULL AS BOOLEAN) AS truncated, 0 AS n FROM rows""")
def result_envelope_not_found(spark, sf_dir):
    return _envelope(_run_adhoc(spark, sf_dir, 10**12), 100)


_DEAREST = """SELECT id, manufacturer, price FROM adhoc_listings WHERE year >= 1995 ORDER BY price DESC NULLS LAST, id"""


@query(f"""{_WITH_ADHOC}, rows AS ({_DEAREST})
SELECT true AS found, CAST(100 AS BIGINT) AS row_count, (SELECT count(*) FROM rows) AS total_rows, true AS truncated,
  CAST(row_number() OVER (ORDER BY price DESC NULLS LAST, id) - 1 AS INT) AS pos, id, price
FROM (SELECT * FROM rows ORDER BY price DESC NULLS LAST, id LIMIT 100)""")
def result_envelope_own_order(spark, sf_dir):
    """The text's order decides which rows are shown."""
    listings(spark, sf_dir).createOrReplaceTempView("adhoc_listings")
    told = F.from_json("result", "found boolean, row_count long, total_rows long, truncated boolean, data array<struct<id:long, price:double>>")
    rows = adhoc.result_envelope(adhoc.run_readonly_sql(spark, _DEAREST, relations=["adhoc_listings"]), 100).select(told.alias("t"))
    shown = rows.select("t.*").select("found", "row_count", "total_rows", "truncated", F.posexplode("data").alias("pos", "row"))
    return shown.select("found", "row_count", "total_rows", "truncated", "pos", "row.id", "row.price")


_ASKED = {
    "answered": "SELECT count(*) AS num_cars_sold FROM adhoc_listings WHERE price > 0",
    "no_such_column": "SELECT count(engine) AS num_cars_sold FROM adhoc_listings",
    "not_allowed": "SELECT count(*) AS num_cars_sold FROM adhoc_others",
    "not_found": "SELECT count(*) AS num_cars_sold FROM adhoc_listings WHERE price < 0 AND price > 0",
    "write": "INSERT INTO adhoc_listings SELECT * FROM adhoc_listings",
}


@query(f"""{_WITH_ADHOC}
SELECT 'answered' AS asked, false AS error, true AS found, (SELECT count(*) FROM listings WHERE price > 0) AS sold, false AS told
UNION ALL SELECT 'not_found', false, false, 0, true
UNION ALL SELECT asked, true, NULL, NULL, true FROM (VALUES ('no_such_column'), ('not_allowed'), ('write')) AS t(asked)""")
def answer_sql(spark, sf_dir):
    """Answers, misses and errors in one form."""
    listings(spark, sf_dir).createOrReplaceTempView("adhoc_listings")
    table(spark, sf_dir, "part").createOrReplaceTempView("adhoc_others")
    told = [(name, adhoc.answer_sql(spark, text, relations=["adhoc_listings"])) for name, text in _ASKED.items()]
    read = F.from_json("answer", "error boolean, found boolean, message string, data array<struct<num_cars_sold:long>>")
    return spark.createDataFrame(told, "asked string, answer string").withColumn("a", read).select(
        "asked", F.coalesce("a.error", F.lit(False)).alias("error"), "a.found",
        F.try_element_at("a.data.num_cars_sold", F.lit(1)).alias("sold"), F.col("a.message").isNotNull().alias("told"),
    )
