import math
import random
import statistics
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from forecourt.operators import market
from forecourt.operators.market import _folders_wanted, comparables, market_estimate, market_stats
from forecourt.sources.tables import write_by_maker

LISTING = "id int, manufacturer string, model string, year int, condition string, odometer int, price double"
REQUEST = "request_id int, manufacturer string, model string, year int, condition string, odometer int"


@pytest.fixture(scope="module")
def cars(spark):
    return spark.createDataFrame([
        (1, "toyota", "Camry LE", 2020, "good", 50000, 20000.0),
        (2, "toyota", "camry", 2019, "Good", 69999, 18000.0),
        (3, "toyota", "camry", 2021, "good", 30000, 23000.0),
        (4, "toyota", "camry", 2022, "good", 50000, 99000.0),
        (5, "toyota", "camry", 2020, None, 50000, 21000.0),
        (6, "toyota", "camry", 2020, "good", None, 22000.0),
        (7, "toyota", "camry", 2020, "good", 50000, 0.0),
        (8, "toyota", "camry", 2020, "good", 50000, -5.0),
        (9, "toyota", None, 2020, "good", 50000, 1.0),
        (10, None, "camry", 2020, "good", 50000, 2.0),
        (11, "ford", "f_150", 2018, "fair", 90000, 15000.0),
        (12, "ford", "f-150", 2018, "fair", 90000, 16000.0),
        (13, "kia", "cee'd", 2017, "fair", 90000, 9000.0),
    ], LISTING)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_all_fields(cars):
    assert ids(comparables(cars, "Toyota", "Camry", 2020, "good", 50000)) == [1, 2, 3]


def test_fields_not_given_are_not_tested(cars):
    assert ids(comparables(cars, "toyota", "camry", 0, "", None)) == [1, 2, 3, 4, 5, 6]
    assert ids(comparables(cars)) == [1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13]


def test_year_and_odometer_windows_are_inclusive(cars):
    assert ids(comparables(cars, model="camry", year=2021, odometer=50000)) == [1, 3, 4, 5, 10]


def test_apostrophe_and_wildcards(cars):
    assert ids(comparables(cars, model="cee'd")) == [13]
    assert ids(comparables(cars, model="f_150")) == [11]
    assert ids(comparables(cars, model="f_150", like_wildcards=True)) == [11, 12]


def test_statistics(cars):
    found = market_stats(comparables(cars, "toyota", "camry", 2020, "good", 50000)).first()
    assert found["average_price"] == pytest.approx(61000 / 3)
    assert found["median_price"] == 20000.0
    assert found["price_std_dev"] == pytest.approx(statistics.stdev([20000, 18000, 23000]))
    assert (found["num_cars_sold"], found["found"], found["hint"]) == (3, True, None)


def test_nothing_found_is_signalled(cars):
    found = market_stats(comparables(cars, "trabant")).first()
    assert (found["average_price"], found["median_price"], found["num_cars_sold"], found["found"]) == (None, None, 0, False)
    assert found["hint"]


def brute_force(request, cars, up=0):
    key, maker, model, year, condition, odometer = request

    def text(cell, wanted):
        return not wanted or (cell is not None and wanted.lower() in cell.lower())

    def near(cell, wanted, window):
        return not wanted or (cell is not None and abs(cell - wanted) <= window)

    ladder = [(condition, 1, odometer), (None, 1, odometer), (None, 3, odometer), (None, None, odometer), (None, None, None)]
    for rung, (state, window, miles) in enumerate(ladder):
        prices = sorted(
            c[6] for c in cars
            if c[6] is not None and c[6] > 0 and text(c[1], maker) and text(c[2], model) and text(c[4], state)
            and (window is None or near(c[3], year, window)) and near(c[5], miles, 20000)
        )
        if prices:
            deviation = statistics.stdev(prices) if len(prices) > 1 else None
            median = prices[(len(prices) + 1) // 2 - 1]
            return up + rung, statistics.fmean(prices), median, deviation, len(prices), True
    if model and len(model.split()) > 1:
        return brute_force((key, maker, model.split()[0], year, condition, odometer), cars, 5)
    return None, None, None, None, 0, False


@pytest.mark.parametrize("max_rows", [1_000_000, 0])
def test_ladder_equals_rung_by_rung_search(spark, max_rows):
    rng = random.Random(11)
    maybe = lambda value: None if rng.random() < 0.15 else value
    makers, models = ["Ford", "ford", "landrover", "Rover"], ["f-150", "F-150 XLT", "ring", "red ring", "a"]
    cars = [
        (i, maybe(rng.choice(makers)), maybe(rng.choice(models)), maybe(rng.randint(1990, 2010)),
         maybe(rng.choice(["good", "like new", "new"])), maybe(rng.randint(0, 150000)), maybe(float(rng.randint(-3, 60))))
        for i in range(300)
    ]
    wanted = [
        (i, maybe(rng.choice(["ford", "rover", "", "RO", "kia"])), maybe(rng.choice(["ring", "f-150", "", "a", "G", "ring gt premium", "F-150 raptor", "no such"])),
         maybe(rng.choice([0, 1985, 2000, 2005, 2030])), maybe(rng.choice(["", "new", "good", "mint"])),
         maybe(rng.choice([0, 20000, 70000, 400000])))
        for i in range(200)
    ]
    found = market_estimate(
        spark.createDataFrame(wanted, REQUEST), spark.createDataFrame(cars, LISTING), max_rows=max_rows
    ).select("request_id", "relax_tier", "average_price", "median_price", "price_std_dev", "num_cars_sold", "found")
    got = sorted(tuple(r) for r in found.collect())
    assert [r[0] for r in got] == [r[0] for r in wanted]
    for answer, request in zip(got, wanted):
        assert answer[1:] == pytest.approx(brute_force(request, cars)), request


def test_sales_in_many_groups_and_parts(spark, monkeypatch):
    for name, value in (("GROUP_SALES", 40), ("GROUP_ASKS", 25), ("STEPS_PER_GROUP", 3)):
        monkeypatch.setattr(market, name, value)
    rng = random.Random(5)
    cars = [
        (i, rng.choice(["Ford", "landrover", None]), rng.choice(["ring", "red ring"]), rng.choice([None, 1999.5, 2000.0, 2001.0, 2003.0]),
         rng.choice(["good", "like new", None]), rng.choice([None, 29999.5, 30000.0, 70000.0, 70000.5, float("nan")]), rng.choice([-1.0, 50.0, 50.0, 50.25, 50.5, 7e5]))
        for i in range(400)
    ]
    listed = spark.createDataFrame(cars, "id int, manufacturer string, model string, year double, condition string, odometer double, price double")
    wanted = [(i, rng.choice(["ford", "rover", ""]), rng.choice(["ring", "red ring xl", ""]), rng.choice([0, 2000, 2002]), rng.choice(["", "new"]), rng.choice([0, 50000, 49999]))
              for i in range(80)]
    found = market_estimate(spark.createDataFrame(wanted, REQUEST), listed).select("request_id", "relax_tier", "average_price", "median_price", "price_std_dev", "num_cars_sold", "found")
    for answer, request in zip(sorted(tuple(r) for r in found.collect()), wanted):
        assert answer[1:] == pytest.approx(brute_force(request, cars)), request


def test_groups_by_rows_worked_on_in_portions(spark, monkeypatch):
    for name, value in (("GROUP_ROWS", 30), ("PORTION", 7), ("GROUP_ASKS", 30)):
        monkeypatch.setattr(market, name, value)
    rng = random.Random(6)
    cars = [
        (i, rng.choice(["ford", "Rover", ""]), rng.choice(["ring", "red ring", None]), rng.choice([None, *range(1999, 2004)]),
         rng.choice(["good", "like new", "", None]), rng.choice([None, 30000, 70001, 90000]), rng.choice([-1.0, 50.0, 50.25, 50.5, 90.0]))
        for i in range(300)
    ]
    wanted = [(i, rng.choice(["ford", "o", ""]), rng.choice(["ring", "red ring xl", ""]), rng.choice([0, 2001, 2006]), rng.choice(["", "new", "good", "mint"]), rng.choice([0, 50000, 50001]))
              for i in range(60)]
    found = market_estimate(spark.createDataFrame(wanted, REQUEST), spark.createDataFrame(cars, LISTING))
    found = found.select("request_id", "relax_tier", "average_price", "median_price", "price_std_dev", "num_cars_sold", "found")
    for answer, request in zip(sorted(tuple(r) for r in found.collect()), wanted):
        assert answer[1:] == pytest.approx(brute_force(request, cars)), request


def test_memory_of_a_group_of_sales(spark):
    """Three million pairs of a sale and what it answers: in a task no more of them are laid out at once than a portion."""
    sales, pairs = 60_000, 50
    miles = np.random.default_rng(3).integers(0, 100_000, sales)
    price = np.arange(sales) / 7
    schema = pa.schema([("_group", pa.int64()), ("_kind", pa.int32()), ("_id", pa.int64()), ("_pair", pa.int64()), ("_year", pa.int64()), ("_miles", pa.int64()),
                        ("_step", pa.int32()), ("_condition", pa.string()), ("_price", pa.float64()), ("_window", pa.int32())])

    def batches():
        of = lambda kind, **columns: pa.RecordBatch.from_pylist([{"_group": 9, "_kind": kind} | dict(zip(columns, v)) for v in zip(*columns.values())], schema)
        yield of(0, _id=[4] * pairs, _pair=range(pairs))
        yield of(1, _id=range(100, 100 + pairs), _pair=range(pairs), _year=[2000, 0] * (pairs // 2), _miles=[50_000] * pairs, _condition=["new", ""] * (pairs // 2), _window=[1] * pairs)
        for i in range(0, sales, 10_000):
            part = slice(i, i + 10_000)
            yield of(2, _id=[4] * 10_000, _year=[4000] * 10_000, _miles=(2 * miles[part]).tolist(), _step=[5] * 10_000, _condition=["like new"] * 10_000, _price=price[part].tolist())

    given = list(batches())
    tracemalloc.start()
    found = [r for batch in market._counter(False)(iter(given)) for r in batch.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = price[abs(miles - 50_000) <= 20_000]
    assert peak < 150e6
    assert sorted(r["_lookup"] for r in found) == list(range(100, 100 + pairs)) and {(r["_step"], r["_n"]) for r in found} == {(5, len(near))}
    assert [r["_sum"] for r in found] == pytest.approx([near.sum()] * pairs) and [r["_squares"] for r in found] == pytest.approx([(near * near).sum()] * pairs)


def test_one_request_equals_the_single_lookup(spark, cars):
    wanted = spark.createDataFrame([(7, "TOYOTA", "camry", 2020, "good", 50000)], REQUEST)
    batch = market_estimate(wanted, cars).select("average_price", "median_price", "num_cars_sold").first()
    single = market_stats(comparables(cars, "TOYOTA", "camry", 2020, "good", 50000)).first()
    assert tuple(batch) == (single["average_price"], single["median_price"], single["num_cars_sold"])


def test_no_nested_loop_in_the_plan(spark, cars):
    wanted = spark.createDataFrame([(7, "toyota", "camry", 2020, "good", 50000)], REQUEST)
    plan = market_estimate(wanted, cars)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbers_kept_as_text(spark, cars):
    texts = cars.selectExpr(
        "id", "manufacturer", "model", "condition", "CAST(year AS string) AS year",
        "CAST(odometer AS string) AS odometer", "IF(id = 3, 'call', CAST(price AS string)) AS price",
    )
    assert ids(comparables(texts, "Toyota", "Camry", 2020, "good", 50000)) == [1, 2]
    wanted = spark.createDataFrame([(7, "toyota", "camry", 2020, "good", 50000)], REQUEST)
    assert market_estimate(wanted, texts).first()["average_price"] == 19000.0


def test_hot_name_without_broadcast(spark):
    cars = spark.range(3000).selectExpr(
        "CAST(id AS int) AS id", "'ford' AS manufacturer", "IF(id % 3 = 0, CAST(id AS string), 'focus') AS model",
        "2000 AS year", "'good' AS condition", "CAST(id AS int) AS odometer", "CAST(id + 1 AS double) AS price",
    )
    wanted = spark.createDataFrame([(i, "ford", "FOCUS", 2000, "good", 10 * i) for i in range(40)], REQUEST)
    one, other = market_estimate(wanted, cars, max_rows=0), market_estimate(wanted, cars)
    assert sorted(one.collect()) == sorted(other.collect())
    assert one.agg({"num_cars_sold": "sum"}).first()[0] == 40 * 2000


def test_price_that_is_no_number(spark, cars):
    odd = cars.selectExpr("*").withColumn("price", F.when(F.col("id") == 1, float("nan")).otherwise(F.col("price")))
    wanted = spark.createDataFrame([(7, "toyota", "camry", 2020, "good", 50000)], REQUEST)
    found = market_estimate(wanted, odd).first()
    assert math.isnan(found["average_price"]) and (found["median_price"], found["num_cars_sold"]) == (23000.0, 3)
    assert math.isnan(market_stats(comparables(odd, "toyota", "camry", 2020, "good", 50000)).first()["average_price"])


def test_missing_fields_and_no_requests(spark, cars):
    only_maker = spark.createDataFrame([(1, "ford")], "request_id int, manufacturer string")
    assert market_estimate(only_maker, cars).first()["num_cars_sold"] == 2
    assert market_estimate(only_maker.limit(0), cars).collect() == []
    assert market_estimate(only_maker, cars.limit(0)).first()["found"] is False


def test_base_model_after_the_ladder(spark):
    cars = spark.createDataFrame(
        [("ford", "fiesta", 2010, "good", 40000, 5000.0), ("ford", "fiesta st", 2015, "good", 90000, 9000.0), ("ford", "focus", 2010, "good", 40000, 7000.0)],
        "manufacturer string, model string, year int, condition string, odometer int, price double",
    )
    asked = spark.createDataFrame(
        [(1, "ford", " Fiesta Zetec S ", "about 2010"), (2, "ford", "fiesta st", "2010"), (3, "ford", "galaxy x", "2010")],
        "request_id int, manufacturer string, model string, year string",
    )
    got = {r["request_id"]: (r["relax_tier"], r["num_cars_sold"], r["median_price"], r["hint"] is None) for r in market_estimate(asked, cars).collect()}
    assert got == {1: (5, 2, 5000.0, True), 2: (3, 1, 9000.0, True), 3: (None, 0, None, False)}


def test_further_fields_and_exact_median(spark):
    cars = spark.createDataFrame([(float(p), "gas" if p % 2 else None) for p in range(1, 20_002)] + [(-1.0, "gas")], "price double, fuel string")
    assert market_stats(comparables(cars)).first()["median_price"] == 10001.0
    assert market_stats(comparables(cars, fuel="GAS", drive="")).first()["num_cars_sold"] == 10001
    assert [tuple(r) for r in market_stats(cars, by=("fuel",)).select("fuel", "median_price", "num_cars_sold").orderBy("fuel").collect()] == [
        (None, 10000.0, 10000), ("gas", 9999.0, 10002)
    ]
    with pytest.raises(ValueError):
        comparables(cars, wheels=4)


def test_folders_of_makers(spark, tmp_path):
    rng = random.Random(8)
    makers = ["ford", "Ford", "land rover", "rover", "kia", "", None, "a/b=c", "z%1", "citro\u00ebn"]
    cars = [(i, rng.choice(makers) if i % 3 else "ford", rng.choice(["one", "two x"]), rng.choice([None, *range(1990, 2000)]), float(rng.randint(-1, 40)), "new", 5000)
            for i in range(600)]
    cars += cars[:50]
    listed = spark.createDataFrame(cars, "id int, manufacturer string, model string, year int, price double, condition string, odometer int")
    for most in (1000, 2, 1):
        name = f"folders_{most}"
        stored = write_by_maker(listed, name, path=str(tmp_path / name), max_folders=most, files=6)
        assert rows(stored.drop("maker_key")) == rows(listed)
        assert stored.select("maker_key").distinct().count() <= most + 1
        one = comparables(stored, "ROVER", year=1995)
        assert rows(one.drop("maker_key")) == rows(comparables(listed, "ROVER", year=1995))
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "Contains(maker_key" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
        asked = spark.createDataFrame([(1, "Rover", "two", 1994, "new"), (2, "kia", "one", 1960, None)], "request_id int, manufacturer string, model string, year int, condition string")
        pairs = spark.createDataFrame([("rover",), ("kia",)], "_want_maker string")
        read = {r[0] for r in _folders_wanted(stored, pairs).select("maker_key").distinct().collect()}
        assert "ford" not in read
        assert read == {r[0] for r in stored.select("maker_key").distinct().collect()} - {"ford", "a/b=c", "z%1"}
        if most == 2:
            assert rows(market_estimate(asked, stored)) == rows(market_estimate(asked, listed))
    hot = spark.read.parquet(str(tmp_path / "folders_1")).filter("maker_key = 'ford'").inputFiles()
    assert len([f for f in hot if "maker_key=ford" in f]) >= 2
    write_by_maker(listed.limit(0), "folders_none", path=str(tmp_path / "none"))
    assert spark.table("folders_none").count() == 0
