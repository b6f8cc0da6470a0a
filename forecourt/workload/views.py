"""The market's tables derived from the test tables, in Spark and as SQL for the check.

listings := lineitem with its part, requests := supplier, price list := part. Nulls,
zero prices and messy model names are made from key columns, since the tables have none.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAKERS = [
    "ford", "toyota", "chevrolet", "honda", "bmw", "audi", "jeep", "kia", "mazda", "nissan", "ram", "rover",
    "land rover", "mini", "mercury", "mercedes-benz", "subaru", "tesla", "volvo", "lexus", "gmc", "dodge", "buick",
    "fiat", "chrysler",
]
CONDITIONS = {"ECONOMY": "fair", "STANDARD": "good", "PROMO": "excellent", "SMALL": "salvage", "MEDIUM": "like new", "LARGE": "new"}
FIRST = ["small", "red", "blue", "large", "hot", "cold", "old", "new"]
LAST = ["ring", "widget", "bolt", "anvil", "gear", "gizmo", "plate", "rod"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _unless(test: Column, value: Column) -> Column:
    return F.when(~test, value)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    sold = table(spark, sf_dir, "lineitem")
    joined = sold.join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    line, order = c("l_linenumber"), c("l_orderkey")
    maker = _pick(MAKERS, F.substring("p_brand", 7, 2).cast("int"))
    state = F.lit(None).cast("string")
    for kind, name in CONDITIONS.items():
        state = F.when(c("p_type") == kind, name).otherwise(state)
    miles = (c("l_quantity") * 2000).cast("int") + (order % 2000).cast("int")
    year = F.year("l_shipdate")
    fuel = F.when(c("l_linestatus") == "O", "gas").otherwise("diesel")
    gears = F.when(c("l_returnflag") == "A", "automatic").when(c("l_returnflag") == "R", "manual")
    drive = F.when(line == 1, "4wd").when(line == 2, "fwd").when(line == 3, "rwd")
    body = _pick(["suv", "sedan", "truck", "wagon"], c("p_size") % 4 + 1)
    color = F.split("p_name", " ")[0]
    told = F.concat_ws(
        " ",
        F.concat(year.cast("string"), F.lit(" "), maker, F.lit(" "), c("p_name")),
        F.concat(body, F.lit(",")), fuel, gears, drive,
        F.concat(F.format_number(miles, 0), F.lit(" miles,")),
        F.concat(state, F.lit(" condition, asking $")),
        F.format_number(F.floor("l_extendedprice"), 0),
    )
    return joined.select(
        (order * 8 + line).alias("id"),
        _unless(c("l_partkey") % 97 == 0, maker).alias("manufacturer"),
        _unless(
            c("l_partkey") % 89 == 0,
            F.when(line == 1, F.upper("p_name")).when(line == 2, F.concat("p_name", F.lit(" 4dr 2.0l"))).otherwise(c("p_name")),
        ).alias("model"),
        _unless(order % 13 == 0, year).alias("year"),
        F.when(order % 101 == 0, 0.0).when(order % 103 == 0, -c("l_extendedprice")).when(order % 107 != 0, c("l_extendedprice")).alias("price"),
        _unless(order % 11 == 0, miles).alias("odometer"),
        _unless(c("l_suppkey") % 9 == 0, state).alias("condition"),
        _unless(line % 3 == 0, fuel).alias("fuel"),
        gears.alias("transmission"),
        drive.alias("drive"),
        _unless(line % 2 == 0, body).alias("type"),
        F.when(color.isin("red", "blue"), color).alias("paint_color"),
        F.concat((c("p_size") % 8 + 1).cast("string"), F.lit(" cylinders")).alias("cylinders"),
        F.when(line == 6, "call for details").when(line != 7, told).alias("description"),
        F.concat(F.lit("http://cars.example/"), order.cast("string")).alias("url"),
        F.lit("clean").alias("title_status"),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_STATE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONDITIONS.items()) + " END"

LISTINGS_SQL = f"""
base AS (
  SELECT *, {_sql_list(MAKERS)}[CAST(substr(p_brand, 7) AS INT)] AS maker, {_STATE} AS state,
    CAST(l_quantity * 2000 AS INT) + CAST(l_orderkey % 2000 AS INT) AS miles,
    CAST(year(l_shipdate) AS INT) AS y,
    CASE WHEN l_linestatus = 'O' THEN 'gas' ELSE 'diesel' END AS f,
    CASE l_returnflag WHEN 'A' THEN 'automatic' WHEN 'R' THEN 'manual' END AS gears,
    CASE l_linenumber WHEN 1 THEN '4wd' WHEN 2 THEN 'fwd' WHEN 3 THEN 'rwd' END AS d,
    ['suv', 'sedan', 'truck', 'wagon'][p_size % 4 + 1] AS body,
    split_part(p_name, ' ', 1) AS color
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
listings AS (
  SELECT l_orderkey * 8 + l_linenumber AS id,
    CASE WHEN l_partkey % 97 <> 0 THEN maker END AS manufacturer,
    CASE WHEN l_partkey % 89 = 0 THEN NULL WHEN l_linenumber = 1 THEN upper(p_name)
      WHEN l_linenumber = 2 THEN p_name || ' 4dr 2.0l' ELSE p_name END AS model,
    CASE WHEN l_orderkey % 13 <> 0 THEN y END AS year,
    CASE WHEN l_orderkey % 101 = 0 THEN 0.0 WHEN l_orderkey % 103 = 0 THEN -l_extendedprice
      WHEN l_orderkey % 107 <> 0 THEN l_extendedprice END AS price,
    CASE WHEN l_orderkey % 11 <> 0 THEN miles END AS odometer,
    CASE WHEN l_suppkey % 9 <> 0 THEN state END AS condition,
    CASE WHEN l_linenumber % 3 <> 0 THEN f END AS fuel,
    gears AS transmission, d AS drive,
    CASE WHEN l_linenumber % 2 <> 0 THEN body END AS type,
    CASE WHEN color IN ('red', 'blue') THEN color END AS paint_color,
    CAST(p_size % 8 + 1 AS VARCHAR) || ' cylinders' AS cylinders,
    CASE WHEN l_linenumber = 6 THEN 'call for details' WHEN l_linenumber <> 7 THEN
      concat_ws(' ', y || ' ' || maker || ' ' || p_name, body || ',', f, gears, d, format('{{:,}}', miles) || ' miles,',
        state || ' condition, asking $', format('{{:,}}', CAST(floor(l_extendedprice) AS BIGINT))) END AS description,
    'http://cars.example/' || l_orderkey AS url, 'clean' AS title_status
  FROM base
)"""


def request_name() -> tuple[Column, Column]:
    """Both words of the model that a request is about."""
    return _pick(FIRST, F.col("s_suppkey") % 8 + 1), _pick(LAST, F.col("s_nationkey") % 8 + 1)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    key = c("s_suppkey")
    maker = _pick(MAKERS, key % 25 + 1)
    first, noun = request_name()
    model = F.concat(first, F.lit(" "), noun)
    return table(spark, sf_dir, "supplier").select(
        key.alias("request_id"),
        F.when(key % 10 == 1, "").when(key % 10 != 0, F.when(key % 3 == 0, F.upper(maker)).otherwise(maker)).alias("manufacturer"),
        F.when(key % 7 != 0, F.when((key % 5 == 2) | (key % 5 == 3), noun).otherwise(model)).alias("model"),
        F.when(key % 70 == 0, 1998).when(key % 17 == 3, 2040).when(key % 6 != 0, 1995 + c("s_nationkey") % 9).alias("year"),
        F.when(key % 70 == 0, "good").when(key % 8 == 3, "mint").when(key % 8 != 5, _pick(list(CONDITIONS.values()), key % 6 + 1)).alias("condition"),
        F.when(key % 70 == 0, 50000).when(key % 19 == 4, 900000).when(key % 9 == 2, 0)
        .when(key % 9 != 5, (c("s_acctbal") * 12).cast("int")).alias("odometer"),
        F.when(key % 3 != 0, F.when(key % 4 == 1, F.concat(F.lit(" "), F.upper(model))).otherwise(F.lit("car won't start, it's dead"))).alias("diagnosis"),
        F.when(key % 4 == 0, F.array(noun, F.lit("PROMO noise")))
        .when(key % 4 == 1, F.array(F.concat(F.lit(" "), model, F.lit(" "))))
        .when(key % 4 == 2, F.array(F.concat(noun, F.lit(" holder")), F.lit("left 100%"))).alias("components"),
    )


REQUESTS_SQL = f"""
named AS (
  SELECT *, {_sql_list(MAKERS)}[s_suppkey % 25 + 1] AS maker, {_sql_list(LAST)}[s_nationkey % 8 + 1] AS noun,
    {_sql_list(FIRST)}[s_suppkey % 8 + 1] || ' ' || {_sql_list(LAST)}[s_nationkey % 8 + 1] AS full_name
  FROM supplier
),
requests AS (
  SELECT s_suppkey AS request_id,
    CASE WHEN s_suppkey % 10 = 1 THEN '' WHEN s_suppkey % 10 <> 0 THEN
      CASE WHEN s_suppkey % 3 = 0 THEN upper(maker) ELSE maker END END AS manufacturer,
    CASE WHEN s_suppkey % 7 <> 0 THEN CASE WHEN s_suppkey % 5 IN (2, 3) THEN noun ELSE full_name END END AS model,
    CASE WHEN s_suppkey % 70 = 0 THEN 1998 WHEN s_suppkey % 17 = 3 THEN 2040
      WHEN s_suppkey % 6 <> 0 THEN 1995 + s_nationkey % 9 END AS year,
    CASE WHEN s_suppkey % 70 = 0 THEN 'good' WHEN s_suppkey % 8 = 3 THEN 'mint'
      WHEN s_suppkey % 8 <> 5 THEN {_sql_list(list(CONDITIONS.values()))}[s_suppkey % 6 + 1] END AS condition,
    CASE WHEN s_suppkey % 70 = 0 THEN 50000 WHEN s_suppkey % 19 = 4 THEN 900000 WHEN s_suppkey % 9 = 2 THEN 0
      WHEN s_suppkey % 9 <> 5 THEN CAST(trunc(s_acctbal * 12) AS INT) END AS odometer,
    CASE WHEN s_suppkey % 3 <> 0 THEN CASE WHEN s_suppkey % 4 = 1 THEN ' ' || upper(full_name)
      ELSE 'car won''t start, it''s dead' END END AS diagnosis,
    CASE s_suppkey % 4 WHEN 0 THEN [noun, 'PROMO noise'] WHEN 1 THEN [' ' || full_name || ' ']
      WHEN 2 THEN [noun || ' holder', 'left 100%'] END AS components
  FROM named
)"""


def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("component"),
        F.concat(F.lower("p_type"), F.lit(" noise from "), F.lower("p_brand")).alias("diagnostic"),
        F.when(F.col("p_partkey") % 31 != 0, F.floor("p_retailprice")).alias("reparation_cost"),
    )


PRICE_LIST_SQL = """
price_list AS (
  SELECT p_name AS component, lower(p_type) || ' noise from ' || lower(p_brand) AS diagnostic,
    CASE WHEN p_partkey % 31 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS reparation_cost
  FROM part
)"""
