"""From a seller's request to a list price and a strategy."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt import schemas as S
from forecourt.functions.text import coerce_components, repair_terms
from forecourt.operators.market import market_estimate
from forecourt.operators.repair import repair_estimate


def request_readiness(requests: DataFrame, critical: list[str] | None = None) -> DataFrame:
    """Add ``missing`` (critical fields that are null or blank) and ``ready`` (none is)."""
    fields = S.CRITICAL_FIELDS if critical is None else critical
    absent = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    missing = F.array_compact(F.array(*[F.when(absent(c), F.lit(c)) for c in fields]))
    return requests.withColumn("missing", missing).withColumn("ready", F.size("missing") == 0)


def advise(
    requests: DataFrame,
    listings: DataFrame,
    catalog: DataFrame,
    request_id: str = "request_id",
    base: str = "average",
    fix_first_below: float = S.FIX_FIRST_BELOW,
) -> DataFrame:
    """List price, price range and strategy for every request (``request_id`` must be unique).

    Only complete requests are priced and only requests that name defects go to the
    repair lookup. List price = base market value (``average`` or ``median``) minus
    repair cost; the range is half a deviation to each side, not below 0, and null without a price. Strategy:
    ``ask`` for missing fields, ``no_market`` without comparable sales, ``no_repair_price``
    if the price list knows none of the defects, ``list`` without repair cost, ``fix_first`` below ``fix_first_below``, else ``as_is``.
    """
    if base not in ("average", "median"):
        raise ValueError(f"base must be average or median, not {base!r}")
    known = request_readiness(coerce_components(requests))
    market = market_estimate(known.filter("ready"), listings, request_id).select(
        request_id, F.col(f"{base}_price").alias("base_value"), "price_std_dev", "num_cars_sold"
    )
    defects = F.size(repair_terms(F.col("diagnosis"), F.col("components"))) > 0
    repair = repair_estimate(known.filter(F.col("ready") & defects), catalog, request_id).select(
        request_id, "num_repairs", F.coalesce("total_estimated_cost", F.lit(0.0)).alias("repair_cost")
    )
    # Keys are unique, so plain joins do.
    joined = (
        known.select(request_id, "missing", "ready", defects.alias("defects"))
        .join(market, request_id, "left").join(repair, request_id, "left")
        .withColumn("unpriced", F.col("ready") & F.col("defects") & (F.coalesce("num_repairs", F.lit(0)) == 0))
    )
    cost = F.when(F.col("ready"), F.coalesce("repair_cost", F.lit(0.0)))
    price = F.col("base_value") - F.col("repair_cost")
    at_least_0 = lambda value: F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))
    half = F.coalesce("price_std_dev", F.lit(0.0)) / 2
    strategy = (
        F.when(~F.col("ready"), "ask")
        .when(F.col("base_value").isNull(), "no_market")
        .when(F.col("unpriced"), "no_repair_price")
        .when(F.col("repair_cost") == 0, "list")
        .when(F.col("repair_cost") < fix_first_below, "fix_first")
        .otherwise("as_is")
    )
    return joined.withColumn("repair_cost", cost).select(
        request_id,
        "ready",
        "missing",
        "base_value",
        "num_cars_sold",
        "repair_cost",
        price.alias("list_price"),
        at_least_0(price - half).alias("price_low"),
        at_least_0(price + half).alias("price_high"),
        strategy.alias("strategy"),
    )
