"""Price statistics of comparable sales, for one vehicle or a whole table of requests."""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt import schemas as S
from forecourt.functions.text import all_of, contains_ci
from forecourt.plans.joins import BROADCAST_ROWS, broadcast_bytes, contains_join, fits_broadcast, is_stored, keyed_join, materialize, scratch, sized
from forecourt.sources.tables import MAKER_KEY, may_hold_maker

MILE_BAND = 10_000
FOLDERS = 10_000
PRICE_STEPS = 64  # per doubling of the price
BASE_MODEL = 5  # added to the rung of a lookup by base model
STEPS_PER_GROUP = 8
GROUP_SALES = 4_000_000  # sales of a group, each counted for every pair of names found in it
GROUP_ROWS = 500_000  # sales of a group, each once
GROUP_ASKS = 500_000
PORTION = 250_000  # sales, and runs of sales, that a task works on at once
_NAME, _ASKED, _SALE = range(3)  # what a row of a group is
_ABSENT = "\u0000"
_NOT_POSITIVE = -1_000_000  # the step of all prices that are not positive
_NOWHERE = -(1 << 60)  # the place of a missing year or odometer, outside of every window
_WANTED = ["_want_maker", "_want_model", "_want_year", "_want_condition", "_want_odometer"]
_FIGURES = ["average_price", "median_price", "price_std_dev", "num_cars_sold"]


def _typed(df: DataFrame) -> DataFrame:
    """Price, year and odometer as numbers where a table keeps them as text; other text is null."""
    texts = [c for c in ("price", "year", "odometer") if c in df.columns and dict(df.dtypes)[c] == "string"]
    return df.withColumns({c: F.col(c).try_cast("double") for c in texts}) if texts else df


def comparables(
    df: DataFrame,
    manufacturer: str | None = None,
    model: str | None = None,
    year: int | None = None,
    condition: str | None = None,
    odometer: int | None = None,
    like_wildcards: bool = False,
    **others: str | int | None,
) -> DataFrame:
    """Listings comparable with one vehicle. Fields that are None, "" or 0 are not tested.

    ``others`` are the further fields of a request: cylinders, fuel, transmission, drive, car_type,
    paint_color. Texts are contained ignoring case, year is within one and odometer within 20000 of
    the given value, price is positive. A null listing cell fails its test. Of a table by ``write_by_maker``
    only the folders that may hold the maker are read.
    """
    tests = [F.col("price") > 0]
    if manufacturer and not like_wildcards and MAKER_KEY in df.columns:
        tests.append(may_hold_maker(F.lit(manufacturer.lower())))
    unknown = set(others) - set(S.SECONDARY_FIELDS)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    more = [(S.SECONDARY_FIELDS[name], str(wanted or "")) for name, wanted in others.items()]
    for column, wanted in (("manufacturer", manufacturer), ("model", model), ("condition", condition), *more):
        if wanted:
            tests.append(contains_ci(F.col(column), wanted, like_wildcards))
    for column, wanted, window in (("year", year, S.YEAR_WINDOW), ("odometer", odometer, S.ODOMETER_WINDOW)):
        if wanted:
            tests.append(F.col(column).between(wanted - window, wanted + window))
    return _typed(df).filter(all_of(tests))


def _with_signal(df: DataFrame) -> DataFrame:
    hint = F.lit("no comparable sale: drop the condition, widen the years or shorten the model name")
    return df.withColumn("found", F.col("num_cars_sold") > 0).withColumn("hint", F.when(~F.col("found"), hint))


def market_stats(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Average, median, sample deviation and count of price, and whether anything was found.

    The median is exact, the lower one of an even count: sales are counted by price step, and the
    prices of the one step that holds a group's median are counted one by one. Both passes
    combine per task, so no group is gathered; pass a stored table.
    """
    key = F.struct(*by) if by else F.lit(0)
    priced = _stepped(_typed(df).filter(F.col("price").isNotNull())).select(key.alias("_lookup"), "price", "_step", "_over")
    figures = materialize(_figures(priced))
    at = figures.select(F.col("_lookup").alias("_of"), "_median_step", "_median_rank")
    in_step = priced.join(sized(at), F.col("_lookup").eqNullSafe(F.col("_of")) & (F.col("_step") == F.col("_median_step")))
    medians = _medians(in_step)
    if by:
        medians = medians.withColumnRenamed("_lookup", "_of")
        found = figures.join(medians, F.col("_lookup").eqNullSafe(F.col("_of")), "left")
    else:  # one row, also without sales
        both = figures.unionByName(medians, allowMissingColumns=True)
        found = both.agg(*[F.max(c).alias(c) for c in _FIGURES])
    groups = [F.col("_lookup")[c].alias(c) for c in by]
    counted = found.select(*groups, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) if c == "num_cars_sold" else c for c in _FIGURES])
    return _with_signal(counted)


def _wanted(requests: DataFrame, request_id: str) -> DataFrame:
    """Request fields with "" and 0 for "not given", texts in lower case; a missing column is not given."""
    given = lambda c: F.col(c) if c in requests.columns else F.lit(None)
    text = lambda c: F.lower(F.coalesce(given(c).cast("string"), F.lit("")))
    number = lambda c: F.coalesce(given(c).cast("string").try_cast("double").try_cast("int"), F.lit(0))
    return requests.select(
        request_id,
        text("manufacturer").alias("_want_maker"),
        text("model").alias("_want_model"),
        number("year").alias("_want_year"),
        text("condition").alias("_want_condition"),
        number("odometer").alias("_want_odometer"),
    )


def _folders_wanted(listings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Listings of the folders that may hold a wanted maker; all of a table without folders.

    Names of folders are read without any column of the files. A table has a bounded number of them (``write_by_maker``),
    and beyond ``FOLDERS`` all are read.
    """
    if MAKER_KEY not in listings.columns:
        return listings
    folders = listings.select(MAKER_KEY).distinct()
    makers = pairs.select("_want_maker").distinct()
    if not fits_broadcast(folders, FOLDERS):
        return listings
    named = contains_join(makers, folders, "_want_maker", MAKER_KEY).select(MAKER_KEY)
    shared = folders.filter(may_hold_maker(F.lit(None).cast("string")))
    wanted = [r[0] for r in named.unionByName(shared).distinct().collect()]
    return listings.filter(F.col(MAKER_KEY).isin(wanted))


def _models_wanted(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """(_pair, _maker, _model): the names on sale that contain a pair of wanted texts.

    Works on distinct names only. The model, where given, is the text searched for and
    the maker is checked on the result; else the maker is searched, "" finding all.
    """
    by_model = F.col("_want_model") != ""
    wanted = pairs.withColumn("_side", F.when(by_model, "model").otherwise("maker")).withColumn(
        "_needle", F.when(by_model, F.col("_want_model")).otherwise(F.col("_want_maker"))
    )
    on_sale = cells.select("_maker", "_model").distinct()
    sides = F.array(
        F.struct(F.lit("model").alias("_side"), F.col("_model").alias("_text")),
        F.struct(F.lit("maker").alias("_side"), F.col("_maker").alias("_text")),
    )
    texts = on_sale.select("_maker", "_model", F.inline(sides))
    # A maker's name is searched once, not once for each of its models.
    found = materialize(contains_join(wanted, texts.select("_side", "_text").distinct(), "_needle", "_text", on=("_side",)))
    named = keyed_join(texts, found, ["_side", "_text"]).filter(F.contains("_maker", "_want_maker"))
    return named.select("_pair", "_maker", "_model")


# What one rung of the ladder asks for; requests that ask for the same share the answer.
_ASK = ["_pair", "_want_year", "_window", "_want_condition", "_want_odometer"]
_KIND = ["_pair", "_by_year", "_by_miles"]
# A pair of names has at most 4 kinds of tests; an ask lies in at most 7 years and 5 bands.
_KINDS = 4
_CELLS = (2 * S.WIDE_YEAR_WINDOW + 1) * (2 * S.ODOMETER_WINDOW // MILE_BAND + 1)


def _fits(df: DataFrame, times: int, max_rows: int) -> bool:
    """Whether ``df`` fits a broadcast even when every row is repeated ``times`` and a pass doubles its width."""
    return fits_broadcast(df, max_rows // times, broadcast_bytes(df.sparkSession) // (2 * times))


def _rungs(climbs: DataFrame, up: int) -> DataFrame:
    """(_climb, relax_tier, ask): what each rung of the ladder asks for.

    0 all given fields, 1 without condition, 2 years within three, 3 without year, 4 without odometer, each higher by ``up``.
    Rungs that ask for the same as the one before are left out, so an answer on a rung has sales of that rung only.
    """
    year, condition, odometer = (F.col(f"_want_{c}") for c in ("year", "condition", "odometer"))
    by_year, none, zero = year != 0, F.lit(""), F.lit(0)
    narrow, wide = F.when(by_year, S.YEAR_WINDOW).otherwise(0), F.lit(S.WIDE_YEAR_WINDOW)
    ladder = [
        (F.lit(True), year, narrow, condition, odometer),
        (condition != "", year, narrow, none, odometer),
        (by_year, year, wide, none, odometer),
        (by_year, zero, zero, none, odometer),
        (odometer != 0, zero, zero, none, zero),
    ]
    steps = [
        F.when(asks, F.struct(F.lit(up + rung).alias("relax_tier"), *[value.alias(name) for name, value in zip(_ASK[1:], ask, strict=True)]))
        for rung, (asks, *ask) in enumerate(ladder)
    ]
    return climbs.select("_climb", "_pair", F.inline(F.array_compact(F.array(*steps)))).select("_climb", "relax_tier", *_ASK)


def _spans(asked: DataFrame) -> DataFrame:
    """Years and miles that the lookups of a pair of names cover together, per kind of test."""
    year, window, miles = F.col("_want_year"), F.col("_window"), F.col("_want_odometer")
    return asked.groupBy(*_KIND).agg(
        F.min(year - window).alias("_first_year"),
        F.max(year + window).alias("_last_year"),
        F.min(miles - S.ODOMETER_WINDOW).alias("_least_miles"),
        F.max(miles + S.ODOMETER_WINDOW).alias("_most_miles"),
    )


def _band(miles: Column) -> Column:
    return F.floor(miles / F.lit(MILE_BAND)).cast("long")


def _cells(asked: DataFrame) -> DataFrame:
    """Asks repeated for the years and bands of miles their sales lie in (0: any)."""
    any_ = F.array(F.lit(0).cast("long"))
    year, miles, window = (F.col(c).cast("long") for c in ("_want_year", "_want_odometer", "_window"))
    years = F.when(F.col("_by_year"), F.sequence(year - window, year + window)).otherwise(any_)
    bands = F.sequence(_band(miles - S.ODOMETER_WINDOW), _band(miles + S.ODOMETER_WINDOW))
    return (
        asked.withColumn("_year", F.explode(years))
        .withColumn("_band", F.explode(F.when(F.col("_by_miles"), bands).otherwise(any_)))
    )


def _meet(cells: DataFrame, asks: DataFrame, max_rows: int, small: tuple[bool, bool]) -> DataFrame:
    """Cells of sales, by pair of names, with the asks that they answer.

    A cell first meets the kinds of asks of its pair that cover its year and miles, then by equality the asks of
    these in it. ``small`` tells what is known to fit a broadcast: the names with their spans, and the cells of the asks.
    """
    asked = asks.withColumn("_by_year", F.col("_want_year") != 0).withColumn("_by_miles", F.col("_want_odometer") != 0)
    within = (~F.col("_by_year") | F.col("year").between(F.col("_first_year"), F.col("_last_year"))) & (
        ~F.col("_by_miles") | ((F.col("_most") >= F.col("_least_miles")) & (F.col("_least") <= F.col("_most_miles")))
    )
    any_ = F.lit(0).cast("long")
    near = (
        keyed_join(cells, _spans(asked), ["_pair"], max_rows=max_rows, small=small[0])
        .filter(within)
        .withColumn("_year", F.when(F.col("_by_year"), F.floor("year").cast("long")).otherwise(any_))
        .withColumn("_band", F.when(F.col("_by_miles"), _band(F.col("_least"))).otherwise(any_))
        .drop("_first_year", "_last_year", "_least_miles", "_most_miles")
    )
    met = keyed_join(near, _cells(asked), [*_KIND, "_year", "_band"], max_rows=max_rows, small=small[1])
    miles = F.col("_want_odometer")
    # A missing cell fails a test that was asked for. Miles asked for span more than a band, so that of a cell of sales
    # one end lies within them if any of its sales does.
    return met.filter(all_of([
        ~F.col("_by_year") | (F.abs(F.col("year") - F.col("_want_year")) <= F.col("_window")),
        ~F.col("_by_miles") | ((F.col("_most") >= miles - S.ODOMETER_WINDOW) & (F.col("_least") <= miles + S.ODOMETER_WINDOW)),
        (F.col("_want_condition") == "") | F.contains("_condition", "_want_condition"),
    ]))


def _on_sale(sales: DataFrame) -> DataFrame:
    """Cells of sales: names, condition, year and band of miles, with the least and most miles of each."""
    banded = sales.withColumn("_band", _band(F.col("odometer")))
    return banded.groupBy("_maker", "_model", "_condition", "year", "_band").agg(F.min("odometer").alias("_least"), F.max("odometer").alias("_most"))


def _answered(cells: DataFrame, names: DataFrame, asks: DataFrame, max_rows: int, small: tuple[bool, bool]) -> DataFrame:
    """(_lookup): the asks that any sale answers, each told from the coarsest cells that decide it; its names are on sale."""
    by_condition, by_year, by_miles = F.col("_want_condition") != "", F.col("_want_year") != 0, F.col("_want_odometer") != 0
    least, most = F.min("_least").alias("_least"), F.max("_most").alias("_most")
    # Cells of all names that a pair is found in are one, so that an ask meets no more of them than it has years, bands and conditions.
    paired = keyed_join(cells, names, ["_maker", "_model"], max_rows=max_rows, small=small[0])
    paired = materialize(paired.groupBy("_pair", "_condition", "year", "_band").agg(least, most))
    coarser = lambda *by: paired.groupBy("_pair", *by, "_band").agg(least, most)
    any_year, none = F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("_condition")
    sides = [
        (by_condition, paired.drop("_band")),
        (~by_condition & by_year, coarser("year").drop("_band").select("*", none)),
        (~by_condition & ~by_year & by_miles, coarser().drop("_band").select("*", none, any_year)),
    ]
    met = [_meet(side, asks.filter(test), max_rows, small).select("_lookup").distinct() for test, side in sides]
    return reduce(DataFrame.unionByName, met, asks.filter(~by_condition & ~by_year & ~by_miles).select("_lookup"))


def _place(value: Column) -> Column:
    """Twice a number between its floor and its ceiling: whole, and on the same side of every whole number as the number."""
    value = value.cast("double")
    return F.when(F.abs(value) < 1e15, F.floor(value) + F.ceil(value)).otherwise(F.lit(_NOWHERE).cast("long"))


def _sold(sales: DataFrame, held: DataFrame, max_rows: int, small: bool) -> DataFrame:
    """Sales with the number of their names, their places on the scales of years and miles, and how many pairs they answer."""
    named = keyed_join(sales, held, ["_maker", "_model"], max_rows=max_rows, small=small).select(
        "_name", "_pairs", "_condition", _place(F.col("year")).alias("_year"), _place(F.col("odometer")).alias("_miles"),
        "_step", "_over", F.col("price").cast("double").alias("_price"),
    )
    return named if small else materialize(named)


def _dealt(sold: DataFrame) -> DataFrame:
    """(_step, _from, _parts): the group of sales that each price step is in, and into how many parts a step too large for one is cut."""
    block = (F.floor(F.col("_step") / F.lit(STEPS_PER_GROUP)) * STEPS_PER_GROUP).cast("long")
    steps = sold.groupBy("_step").agg(F.sum("_pairs").alias("_n"), F.count("*").alias("_rows")).withColumn("_from", block)
    of_block = lambda c: F.sum(c).over(Window.partitionBy("_from"))
    whole = (of_block("_n") <= GROUP_SALES) & (of_block("_rows") <= GROUP_ROWS)
    parts = F.greatest(F.ceil(F.col("_n") / F.lit(GROUP_SALES)), F.ceil(F.col("_rows") / F.lit(GROUP_ROWS)))
    return steps.withColumn("_whole", whole).select(
        "_step",
        F.when(F.col("_whole"), F.col("_from")).otherwise(F.col("_step").cast("long")).alias("_from"),
        F.when(F.col("_whole"), F.lit(1)).otherwise(parts).cast("long").alias("_parts"),
    )


def _in_groups(sold: DataFrame, dealt: DataFrame, asks: DataFrame, named: DataFrame, by_step: bool) -> DataFrame:
    """Counts of the sales that every ask meets, group by group of sales.

    All asks go to each group, or with ``by_step`` each ask to the parts of its median's step alone; with them go the
    pairs by name. Beyond ``GROUP_ASKS`` the asks are dealt to shares, and sales go to each of these. Rows of all three kinds
    come to their group as one sorted stream, and share columns: ``_id`` is the name of a sale and of a pair's name, and the lookup of an ask.
    """
    shares = max(1, -(-asks.count() // GROUP_ASKS))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    group = ((F.col("_from") * F.lit(1 << 24) + F.col("_part")) * F.lit(shares) + F.col("_share")).alias("_group")
    asks = asks.withColumn("_share", F.pmod(F.xxhash64("_lookup"), F.lit(shares)))
    if by_step:
        dealt = dealt.join(F.broadcast(asks.select(F.col("_median_step").alias("_step")).distinct()), "_step")
    parts = materialize(dealt.select("_from", "_parts").distinct().withColumn("_part", upto(F.col("_parts"))))
    if by_step:
        asked = asks.join(F.broadcast(dealt.withColumnRenamed("_step", "_median_step")), "_median_step").withColumn("_part", upto(F.col("_parts")))
    else:
        asked = asks.crossJoin(F.broadcast(parts))
    names = named.crossJoin(F.broadcast(parts)).withColumn("_share", upto(F.lit(shares).cast("long")))
    spread = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in sold.columns])
    sales = (
        sold.withColumn("_spread", spread).join(F.broadcast(dealt), "_step").withColumn("_part", F.pmod("_spread", "_parts"))
        .withColumn("_share", upto(F.lit(shares).cast("long")))
    )
    types = {"_pair": "long", "_year": "long", "_miles": "long", "_step": "int", "_condition": "string", "_price": "double", "_window": "int"}
    of_median = {"_step": "_median_step", "_median_rank": "_median_rank", "_parts": "_parts"} if by_step else {}
    types |= {c: "long" for c in of_median if c not in types}
    row = lambda kind, given: [group, F.lit(kind).alias("_kind"), F.col(given["_id"]).alias("_id")] + [
        (F.col(given[c]) if c in given else F.lit(None)).cast(kind_of).alias(c) for c, kind_of in types.items()
    ]
    asked_for = {"_pair": "_pair", "_year": "_want_year", "_miles": "_want_odometer", "_condition": "_want_condition", "_window": "_window"}
    of_sale = {c: c for c in ("_year", "_miles", "_step", "_condition")} | {"_price": "_price" if by_step else "_over"}
    rows = [
        names.select(*row(_NAME, {"_id": "_name", "_pair": "_pair"})),
        asked.select(*row(_ASKED, {"_id": "_lookup"} | asked_for | of_median)),
        sales.select(*row(_SALE, {"_id": "_name"} | of_sale)),
    ]
    stream = reduce(DataFrame.unionByName, rows).repartition("_group").sortWithinPartitions("_group", "_kind")
    schema = "_lookup long, _median_rank long, price double, _n long" if by_step else "_lookup long, _step int, _n long, _sum double, _squares double"
    return stream.mapInArrow(_counter(by_step), schema)


def _counter(by_step: bool):
    """The function of a stream of groups: sales and asks -> counts per ask and price step, or the prices of the median's step.

    A group's rows are kept as numbers. Its pairs are taken in portions: their sales are sorted by pair, condition, year, step and
    miles, once for each pair that they answer, so that those of an ask are a run for each of its conditions and years, found by
    bisection; the asks of a portion are taken by so many runs. Memory so is that of a group's rows and of one portion, however
    many pairs its sales answer and runs its asks have; what is found leaves portion by portion. Functions are nested to be sent by value.
    """
    window, portion, (name_kind, ask_kind, sale_kind) = 2 * S.ODOMETER_WINDOW, PORTION, (_NAME, _ASKED, _SALE)
    fields = {
        name_kind: ["_id", "_pair"],
        ask_kind: ["_id", "_pair", "_year", "_miles", "_window", "_condition", *(["_step", "_median_rank", "_parts"] if by_step else [])],
        sale_kind: ["_id", "_year", "_miles", "_step", "_condition", "_price"],
    }

    def runs(starts, lengths):
        owner = np.repeat(np.arange(len(starts)), lengths)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[owner]

    def portions(sizes):
        """Ends of neighbours that make up a portion together, or are one alone."""
        which = (np.cumsum(sizes) - sizes) // portion
        return np.unique(np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(sizes)]]))

    def between(scale, wanted, width):
        low, high = np.searchsorted(scale, 2 * wanted - width), np.searchsorted(scale, 2 * wanted + width, "right")
        return np.where(wanted != 0, low, 0), np.where(wanted != 0, high, len(scale))

    def figures(code, row, sales, asks, at, ask, start, low, high, steps, width):
        # Sums up to a sale are of 80 bits, so that differences are right in all digits of a double.
        over = sales["_price"][row].astype(np.longdouble)
        upto = lambda values: np.concatenate([[np.longdouble(0)], np.cumsum(values)])
        sums, squares = upto(over), upto(over * over)
        for i, step in enumerate(steps):
            begin, end = np.searchsorted(code, (start + i) * width + low), np.searchsorted(code, (start + i) * width + high)
            met = end > begin
            begin, end, of = begin[met], end[met], ask[met]
            per = lambda values: np.bincount(of, values.astype(float), len(at))
            n = per(end - begin)
            told = n > 0
            yield asks["_id"][at[told]], np.full(told.sum(), step), n[told], per(sums[end] - sums[begin])[told], per(squares[end] - squares[begin])[told]

    def prices(code, row, sales, asks, at, ask, start, low, high, steps, width):
        wanted = asks["_step"][at]
        step = np.searchsorted(steps, wanted)
        here = (step < len(steps)) & (steps[np.minimum(step, len(steps) - 1)] == wanted)
        begin, end = (np.searchsorted(code, (start + step[ask]) * width + side) for side in (low, high))
        met = (end > begin) & here[ask]
        begin, end, ask = begin[met], end[met], ask[met]
        ends = np.searchsorted(ask, np.arange(len(at) + 1))
        price, held, waiting = sales["_price"][row], [], 0
        for i, (lookup, rank, parts) in enumerate(zip(asks["_id"][at], asks["_median_rank"][at], asks["_parts"][at])):
            if ends[i] == ends[i + 1]:
                continue
            own = np.concatenate([price[b:e] for b, e in zip(begin[ends[i]:ends[i + 1]], end[ends[i]:ends[i + 1]])])
            # A step in one part has all that the ask meets: the one price; else parts are counted together.
            own, n = (np.partition(own, rank - 1)[rank - 1:rank], np.array([rank])) if parts == 1 else np.unique(own, return_counts=True)
            held.append((np.full(len(own), lookup), np.full(len(own), rank), own, n))
            waiting += len(own)
            if waiting > portion:
                yield [np.concatenate(c) for c in zip(*held)]
                held, waiting = [], 0
        if held:
            yield [np.concatenate(c) for c in zip(*held)]

    def solve(names, asks, sales, wants, states):
        """What the asks of a group find. Conditions are places in ``wants`` and ``states``, those asked for and those of sales; -1 is none."""
        pairs, pair = np.unique(asks["_pair"], return_inverse=True)
        asked = np.isin(names["_pair"], pairs)
        names = {c: v[asked] for c, v in names.items()}
        known = np.unique(names["_id"])
        own = np.searchsorted(known, sales["_id"])
        order = np.argsort(own, kind="stable")
        order = order[known[np.minimum(own[order], len(known) - 1)] == sales["_id"][order]] if len(known) else order[:0]
        if not len(order):
            return
        # Sales stand in the order of their names, and pairs take theirs by name.
        sales, own = {c: v[order] for c, v in sales.items() if c != "_id"}, own[order]
        of, name = np.searchsorted(pairs, names["_pair"]), np.searchsorted(known, names["_id"])
        order = np.argsort(of, kind="stable")
        of, name = of[order], name[order]
        count = np.bincount(own, minlength=len(known))
        first = np.cumsum(count) - count
        ends = portions(np.bincount(of, count[name], len(pairs)).astype(np.int64))
        (years, year), (miles, mile), (steps, step) = (np.unique(sales[c], return_inverse=True) for c in ("_year", "_miles", "_step"))
        n_states, state = len(states) + 1, sales["_condition"] + 1
        by_pair = np.argsort(pair, kind="stable")
        # The states that fit what is asked for, one after the other.
        fitting = [[i for i in range(n_states) if w == "" or (i and w in states[i - 1])] for w in wants]
        fits, fitting = np.array([len(f) for f in fitting]), np.array([i for f in fitting for i in f], dtype=np.int64)
        from_state = np.cumsum(fits) - fits
        low_year, high_year = between(years, asks["_year"], 2 * asks["_window"])
        low_mile, high_mile = between(miles, asks["_miles"], window)
        for begin, end in zip(ends[:-1], ends[1:]):
            these = slice(*np.searchsorted(of, [begin, end]))
            at, row = runs(first[name[these]], count[name[these]])
            code = of[these][at] - begin
            for values, n in ((state, n_states), (year, len(years)), (step, len(steps)), (mile, len(miles))):
                code *= n
                code += values[row]
            order = np.argsort(code)
            code, row = code[order], row[order]
            mine = by_pair[slice(*np.searchsorted(pair[by_pair], [begin, end]))]
            want, length = asks["_condition"][mine], (high_year - low_year)[mine]
            cuts = portions(fits[want] * length)
            for a, b in zip(cuts[:-1], cuts[1:]):
                at, wanted, n = mine[a:b], want[a:b], length[a:b]
                ask, fit = runs(from_state[wanted], fits[wanted])
                among, from_year = runs(low_year[at][ask], n[ask])
                start = (((pair[at][ask] - begin) * n_states + fitting[fit]) * len(years))[among] + from_year
                ask = ask[among]
                yield from (prices if by_step else figures)(
                    code, row, sales, asks, at, ask, start * len(steps), low_mile[at][ask], high_mile[at][ask], steps, len(miles)
                )

    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64()] if by_step else [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
    columns = ["_lookup", "_median_rank", "price", "_n"] if by_step else ["_lookup", "_step", "_n", "_sum", "_squares"]

    def numbers(column, states):
        """A column's values as numbers of their own memory; of texts their places in ``states``, which grows."""
        if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
            return np.array(column.to_numpy(zero_copy_only=False))
        if column.null_count == len(column):
            return np.full(len(column), -1, dtype=np.int32)
        coded = column.dictionary_encode()
        places = np.array([states.setdefault(text, len(states)) for text in coded.dictionary.to_pylist()], dtype=np.int32)
        return np.append(places, np.int32(-1))[coded.indices.fill_null(len(places)).to_numpy()]

    def run(batches):
        group, held, states = None, {}, {kind: {} for kind in fields}

        def found():
            got = {kind: {c: np.concatenate([part.pop(0) for part in parts]) for c in fields[kind]} for kind, parts in held.items()}
            held.clear()
            if len(got) == len(fields):
                with np.errstate(invalid="ignore"):
                    for values in solve(got[name_kind], got[ask_kind], got[sale_kind], list(states[ask_kind]), list(states[sale_kind])):
                        yield pa.RecordBatch.from_arrays([pa.array(v.astype(t.to_pandas_dtype()), t) for v, t in zip(values, types)], names=columns)

        for batch in batches:
            groups, kinds = batch.column("_group").to_numpy(), batch.column("_kind").to_numpy()
            cuts = np.flatnonzero(np.diff(groups) | np.diff(kinds)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(groups)]):
                if b > a:
                    if groups[a] != group:
                        yield from found()
                        group, states = groups[a], {kind: {} for kind in fields}
                    part, kind = batch.slice(a, b - a), int(kinds[a])
                    held.setdefault(kind, []).append([numbers(part.column(c), states[kind]) for c in fields[kind]])
        yield from found()

    return run


def _price_step(price: Column) -> Column:
    """Number of the price step, growing with the price; a step is about 1.1 percent wide.
    NaN and infinity share the last one."""
    price = price.cast("double")
    return F.when(price < 1e300, F.floor(F.log2(price) * PRICE_STEPS).cast("int")).otherwise(1_000_000)


def _stepped(sales: DataFrame) -> DataFrame:
    """Sales with their price step and what their price lies above the step's."""
    price = F.col("price").cast("double")
    step = F.when(price > 0, _price_step(price)).otherwise(_NOT_POSITIVE)
    start = F.when(F.col("_step") == _NOT_POSITIVE, 0.0).otherwise(_step_price(F.col("_step")))
    return sales.withColumn("_step", step).withColumn("_over", price - start)


def _step_price(step: Column) -> Column:
    return F.pow(F.lit(2.0), step / F.lit(PRICE_STEPS))


def _figures(met: DataFrame) -> DataFrame:
    """Statistics per lookup from counts per price step, and where its median lies:
    the step, and the median's rank among the sales in that step."""
    over = F.col("_over")
    return _of_steps(met.groupBy("_lookup", "_step").agg(
        F.count("*").alias("_n"), F.sum(over).alias("_sum"), F.sum(over * over).alias("_squares")
    ))


def _of_steps(steps: DataFrame) -> DataFrame:
    """``_figures`` from the count, sum and squares of each price step."""
    lookup = Window.partitionBy("_lookup")
    up_to = lookup.orderBy("_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, total, mean = F.col("_n"), F.col("_total"), F.col("_mean")
    steps = (
        steps.withColumn("_mean", F.when(F.col("_step") == _NOT_POSITIVE, 0.0).otherwise(_step_price(F.col("_step"))) + F.col("_sum") / n)
        .withColumn("_within", F.greatest(F.col("_squares") - F.col("_sum") * F.col("_sum") / n, F.lit(0.0)))
        .withColumn("_total", F.sum("_n").over(lookup))
        .withColumn("_whole", F.sum(n * mean).over(lookup) / total)
        .withColumn("_before", F.sum("_n").over(up_to) - n)
        .withColumn("_rank", F.floor((total + 1) / F.lit(2)) - F.col("_before"))
    )
    at_median = F.when((F.col("_rank") >= 1) & (F.col("_rank") <= n), F.col("_step"))
    squares = F.sum(F.col("_within") + n * F.pow(mean - F.col("_whole"), F.lit(2)))
    count = F.max("_total")
    return steps.groupBy("_lookup").agg(
        F.max("_whole").alias("average_price"),
        F.sqrt(squares / F.nullif(count - 1, F.lit(0))).alias("price_std_dev"),
        count.alias("num_cars_sold"),
        F.max(at_median).alias("_median_step"),
        F.max(F.when(at_median.isNotNull(), F.col("_rank"))).alias("_median_rank"),
    )


def _medians(met: DataFrame) -> DataFrame:
    """The price of rank ``_median_rank`` per lookup; ``met`` holds the sales of one price step."""
    return _reached(met.groupBy("_lookup", "_median_rank", "price").agg(F.count("*").alias("_n")))


def _reached(prices: DataFrame) -> DataFrame:
    """The first price per lookup at which the counts reach ``_median_rank``."""
    up_to = Window.partitionBy("_lookup").orderBy("price").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.sum("_n").over(up_to) >= F.col("_median_rank")
    return (
        prices.withColumn("_reached", reached).filter("_reached")
        .groupBy("_lookup").agg(F.min("price").cast("double").alias("median_price"))
    )


def market_estimate(
    requests: DataFrame,
    listings: DataFrame,
    request_id: str = "request_id",
    max_rows: int = BROADCAST_ROWS,
    base_model: bool = True,
) -> DataFrame:
    """Price statistics of comparable sales for every request, relaxing filters where nothing matches.

    ``requests`` has a unique ``request_id`` and the vehicle fields. ``relax_tier`` is the first rung of the ladder with
    any sale: 0 all given fields, 1 without condition, 2 years within three, 3 without year, 4 without
    odometer; requests whose model has several words go on, with ``base_model``, to the same rungs with its first word
    alone, higher by ``BASE_MODEL``. Requests without any sale come back with nulls and count 0.

    What a rung asks for is asked once, however many requests do. ``listings`` is scanned three times, six columns of it (unless
    it is stored, these are written once and read from there). The first scan gives the distinct cells on sale: names, condition,
    year and band of miles, with the least and most miles of each, which tell exactly what asks have any sale, and so each
    request's rung. The second counts the sales of the asks that were taken by price step, and the third reads the prices of the one step that holds the
    median. Sales are not compared with asks one by one: they are dealt by price step into groups of bounded size, sorted there by
    names, condition, year and miles, and the sales of an ask are found by bisection, so that work grows with the sales, and with asks times groups.
    A table by ``write_by_maker`` is read in the folders of wanted makers alone; no ask gathers its sales in one task.
    """
    spark = requests.sparkSession
    with scratch(spark) as keep:
        best = keep(_best_figures(requests, listings, request_id, max_rows, base_model))
    wanted = _wanted(requests, request_id)
    answered = keyed_join(wanted, best, _WANTED, "left", max_rows=max_rows).select(request_id, "relax_tier", *_FIGURES)
    return _with_signal(answered.withColumn("num_cars_sold", F.coalesce("num_cars_sold", F.lit(0).cast("long"))))


def ladder_estimate(requests: DataFrame, listings: DataFrame, request_id: str = "request_id", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``market_estimate`` with the rungs of the whole model name alone."""
    return market_estimate(requests, listings, request_id, max_rows, base_model=False)


def _best_figures(requests: DataFrame, listings: DataFrame, request_id: str, max_rows: int, base_model: bool) -> DataFrame:
    """The stored figures of each distinct set of wanted fields that any sale answers."""
    # The smallest request names a climb: a short key that is the same in every run.
    climbs = materialize(_wanted(requests, request_id).groupBy(*_WANTED).agg(F.min(request_id).alias("_climb")))
    words = F.split(F.btrim("_want_model", F.lit(" \t\n\r\x0b\x0c")), r"\s+")
    ladders = [(climbs, 0)]
    if base_model:
        ladders.append((climbs.filter(F.size(words) > 1).withColumn("_want_model", words[0]), BASE_MODEL))
    asked_names = reduce(DataFrame.unionByName, [c.select("_want_maker", "_want_model") for c, _ in ladders])
    pairs = materialize(asked_names.distinct().withColumn("_pair", F.monotonically_increasing_id()))
    sales = _sales(_folders_wanted(listings, pairs))
    cells = materialize(_on_sale(sales))
    names = materialize(_models_wanted(pairs, cells))
    known = pairs.join(names.select("_pair").distinct(), "_pair", "left_semi")
    steps = materialize(reduce(DataFrame.unionByName, [_rungs(c.join(known, ["_want_maker", "_want_model"]), up) for c, up in ladders]))
    asks = materialize(steps.select(*_ASK).distinct().withColumn("_lookup", F.monotonically_increasing_id()))
    small = (_fits(names, _KINDS, max_rows), _fits(asks, _CELLS, max_rows))
    answered = steps.join(sized(asks), _ASK).join(_answered(cells, names, asks, max_rows, small), "_lookup")
    first = F.min(F.struct("relax_tier", "_lookup")).alias("_taken")
    taken = materialize(answered.groupBy("_climb").agg(first).select("_climb", "_taken.*"))
    chosen = materialize(asks.join(sized(taken.select("_lookup").distinct()), "_lookup"))

    names = names.join(chosen.select("_pair").distinct(), "_pair", "left_semi")
    held = materialize(names.groupBy("_maker", "_model").agg(F.count("*").alias("_pairs")).withColumn("_name", F.monotonically_increasing_id()))
    named = materialize(names.join(held, ["_maker", "_model"]).select("_pair", "_name"))
    sold = _sold(sales, held, max_rows, small[0])
    dealt = materialize(_dealt(sold))
    counts = _in_groups(sold, dealt, chosen, named, False).groupBy("_lookup", "_step").agg(*[F.sum(c).alias(c) for c in ("_n", "_sum", "_squares")])
    figures = materialize(_of_steps(counts))
    ranked = materialize(chosen.join(sized(figures.select("_lookup", "_median_step", "_median_rank")), "_lookup"))
    prices = _in_groups(sold, dealt, ranked, named, True).groupBy("_lookup", "_median_rank", "price").agg(F.sum("_n").alias("_n"))
    medians = _reached(prices)
    return materialize(climbs.join(sized(taken), "_climb").join(sized(figures), "_lookup").join(medians, "_lookup").select(*_WANTED, "relax_tier", *_FIGURES))


def _sales(listings: DataFrame) -> DataFrame:
    """Sales with lower-cased names, typed figures and their price step; stored unless ``listings`` is."""
    name = lambda c: F.lower(F.coalesce(F.col(c), F.lit(_ABSENT)))
    sales = _typed(listings).filter(F.col("price") > 0).select(
        name("manufacturer").alias("_maker"),
        name("model").alias("_model"),
        F.lower("condition").alias("_condition"),
        "year",
        "odometer",
        "price",
    )
    sales = (sales if is_stored(listings) else materialize(sales)).withColumn("_step", _price_step(F.col("price")))
    return sales.withColumn("_over", F.col("price").cast("double") - _step_price(F.col("_step")))
