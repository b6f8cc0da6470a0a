"""Table schemas and the fixed values the operators share."""

from pyspark.sql import types as T

# --- fixed values: names and numbers that decide results -------------------
TARGET_MANUFACTURERS = ["ford", "toyota", "chevrolet", "honda"]
COLUMNS_TO_DROP = [
    "url", "region", "region_url", "VIN", "image_url", "county",
    "size", "title_status", "state", "lat", "long", "posting_date",
]
SAMPLE_FRACTION = 0.01
YEAR_WINDOW = 1
WIDE_YEAR_WINDOW = 3
ODOMETER_WINDOW = 20000
MARKET_ROW_CAP = 100
FIX_FIRST_BELOW = 300
SECONDARY_FIELDS = {
    "cylinders": "cylinders", "fuel": "fuel", "transmission": "transmission", "drive": "drive", "car_type": "type",
    "paint_color": "paint_color",
}
CRITICAL_FIELDS = ["manufacturer", "model", "year", "odometer", "condition"]
EXTRACTED_FIELDS = [
    "manufacturer", "model", "year", "price", "odometer", "transmission",
    "fuel", "drive", "type", "paint_color", "condition",
]
# --- end of fixed values ---------------------------------------------------

LISTING = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("region_url", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("manufacturer", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("cylinders", T.StringType()),
    T.StructField("fuel", T.StringType()),
    T.StructField("odometer", T.DoubleType()),
    T.StructField("title_status", T.StringType()),
    T.StructField("transmission", T.StringType()),
    T.StructField("VIN", T.StringType()),
    T.StructField("drive", T.StringType()),
    T.StructField("size", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("paint_color", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("county", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()),
    T.StructField("posting_date", T.StringType()),
])

REPAIR_CATALOG = T.StructType([
    T.StructField("component", T.StringType()),
    T.StructField("diagnostic", T.StringType()),
    T.StructField("reparation_cost", T.IntegerType()),
])

EXTRACTED = T.StructType([T.StructField(f, T.StringType()) for f in EXTRACTED_FIELDS])

DICTIONARY = T.StructType([
    T.StructField("manufacturer", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("canonical", T.StringType()),
])

REPLY_BLOCKS = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
]))
