import time

import pytest
from pyspark.sql import Observation

from conftest import rows
from forecourt import schemas as S
from forecourt.operators import enrich, models, quality
from forecourt.plans import refine
from forecourt.workload import listing_queries

TEXT = "2019 Ford Focus Sedan 2.0L 4dr 4WD, Automatic, gas, 45,000 miles, Like New, silver, asking $12,500.50"


def test_rules(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "call me"), (3, None)], "id int, description string")
    found = {r["id"]: r["extracted_data"].asDict() for r in enrich.extract_fields_rules(df).collect()}
    assert found[1] == {
        "manufacturer": "ford", "model": "focus", "year": "2019", "price": "12500.50", "odometer": "45000",
        "transmission": "automatic", "fuel": "gas", "drive": "4wd", "type": "sedan", "paint_color": "silver",
        "condition": "like new",
    }
    assert set(found[2].values()) == set(found[3].values()) == {None}
    in_km = enrich.extract_fields_rules(df, km_per_mile=1.609344).filter("id = 1").first()["extracted_data"]
    assert in_km["odometer"] == "72420"


def test_late_text_is_read_too(spark):
    df = spark.createDataFrame([("x " * 50_000 + "1999 honda civic",)], "description string")
    assert enrich.extract_fields_rules(df).first()["extracted_data"]["model"] == "civic"


def test_udf_gives_nulls_for_failures_and_partial_answers(spark):
    def make():
        calls = []

        def extract(text):
            calls.append(text)
            if text == "fail":
                raise RuntimeError("service down")
            if text == "none":
                return None
            return {"year": 2019, "model": text, "extra": 1}

        return extract

    df = spark.createDataFrame([(1, "fail"), (2, "none"), (3, "civic")], "id int, description string")
    out = enrich.extract_fields_udf(df, make, partitions=2)
    found = {r["id"]: r["extracted_data"] for r in out.collect()}
    assert out.schema["extracted_data"].dataType == S.EXTRACTED
    assert set(found[1].asDict().values()) == set(found[2].asDict().values()) == {None}
    assert (found[3]["year"], found[3]["model"], found[3]["price"]) == ("2019", "civic", None)


@pytest.mark.parametrize("max_rows", [1000, 0])
def test_texts_are_asked_about_once(spark, tmp_path, max_rows):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()

    def counting(fails):
        def make():
            def extract(text):
                (calls / f"{len(list(calls.iterdir()))}-{abs(hash(text))}-{time.time_ns()}").write_text(text)
                if text in fails:
                    raise OSError
                return {"fuel": text.upper(), "other": 1}
            return extract
        return make

    def asked():
        found = sorted(f.read_text() for f in calls.iterdir())
        for f in calls.iterdir():
            f.unlink()
        return found

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", None, "", "c", "a"])], "id int, description string")
    run = lambda frame, fails=(): rows(enrich.extract_fields_stored(frame, counting(fails), store, max_rows=max_rows).select("id", "extracted_data.fuel"))
    assert run(df, ("b",)) == [(0, "A"), (1, None), (2, "A"), (3, None), (4, ""), (5, "C"), (6, "A")]
    assert asked() == ["", "a", "b", "c"]
    assert run(df)[1] == (1, "B") and asked() == ["b"]
    assert run(df)[1] == (1, "B") and asked() == []
    assert run(df.unionByName(spark.createDataFrame([(9, "d")], df.schema)))[-1] == (9, "D") and asked() == ["d"]
    assert run(df.limit(0)) == [] and asked() == []


def test_stored_results_of_keys_shared_by_many_rows(spark, tmp_path):
    texts = ["hot"] * 300 + ["warm"] * 60 + [None] * 300 + [f"t{i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, description string")
    make = lambda: lambda text: {"fuel": text.upper()}
    found = enrich.extract_fields_stored(df, make, str(tmp_path / "store"), max_rows=0, rows_per_task=50)
    assert rows(found.select("id", "extracted_data.fuel")) == rows(df.selectExpr("id", "upper(description) AS fuel"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert stored.count() == stored.select("_digest").distinct().count() == 202


def test_refreshed_chain_extracts_without_a_fixed_number_of_tasks(spark, monkeypatch):
    cars = spark.createDataFrame([(i, "2001 ford") for i in range(30)], "id int, description string").repartition(13)
    prices = spark.createDataFrame([("a", "b", 1)], "component string, diagnostic string, reparation_cost long")
    monkeypatch.setattr(listing_queries, "listings", lambda *_: cars)
    monkeypatch.setattr(listing_queries, "price_list", lambda *_: prices)
    monkeypatch.setattr(listing_queries.files, "write_csv", lambda *_: None)
    monkeypatch.setattr(listing_queries.refine, "refresh_tables", lambda *given, **_: given[5](cars))
    _, told = listing_queries._refreshed(spark, "")
    assert told.rdd.getNumPartitions() == 13
    assert rows(told.select("id", "extracted_data.year", "extracted_data.fuel")) == sorted(((i, "2001", None) for i in range(30)), key=repr)


def merged(spark, **options):
    df = spark.createDataFrame([
        (1, "d", None, None, "", 1.0, "cyl", ("ford", "2001", "red", "9.5")),
        (2, "d", "bmw", 1999, None, None, None, (None, "many", "blue", "cheap")),
    ], "id int, description string, manufacturer string, year int, paint_color string, price double, cylinders string, "
       "extracted_data struct<manufacturer:string,year:string,paint_color:string,price:string>")
    return enrich.merge_extracted(df, **options)


def test_merge_fills_only_nulls_and_keeps_types(spark):
    out = merged(spark)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in out.schema] == [
        "manufacturer string", "year int", "paint_color string", "price double", "cylinders string"
    ]
    assert rows(out) == [("bmw", 1999, "blue", None, None), ("ford", 2001, "", 1.0, "cyl")]


def test_merge_to_strings(spark):
    out = merged(spark, legacy_string=True)
    assert rows(out) == [("bmw", "1999", "blue", "cheap", None), ("ford", "2001", "", "1.0", "cyl")]


def test_null_profile_counts_nan(spark):
    df = spark.createDataFrame([(None, 1.0), ("x", float("nan")), ("y", None)], "a string, `b c` double")
    assert rows(quality.null_profile(df)) == [("a", 1, 3), ("b c", 2, 3)]


def test_recovery_report(spark):
    before = spark.createDataFrame([(None, None, None), ("x", None, "d")], "a string, b string, description string")
    after = spark.createDataFrame([("f", None), ("x", "g")], "a string, b string")
    assert tuple(quality.recovery_report(before, after).first()) == (3, 1, 2, 66.67)
    assert tuple(quality.recovery_report(before, after, same_columns=False).first()) == (4, 1, 3, 75.0)
    full = after.filter("a = 'x'")
    assert tuple(quality.recovery_report(full, full).first()) == (0, 0, 0, 0.0)


@pytest.mark.parametrize("same_columns", [True, False])
@pytest.mark.parametrize("legacy_string", [True, False])
def test_reports_from_one_scan(spark, same_columns, legacy_string):
    cars = [(1, None, float("nan"), None, TEXT), (None, "ford", 2.0, "x", None), (3, None, None, None, "none"), (None, "", 1.0, "y", TEXT)]
    df = enrich.extract_fields_rules(spark.createDataFrame(cars, "id int, manufacturer string, price double, other string, description string"))
    merged = enrich.merge_extracted(df, legacy_string=legacy_string)
    want = rows(quality.recovery_report(df.drop("extracted_data"), merged, same_columns))
    assert rows(enrich.merge_report(df, legacy_string=legacy_string, same_columns=same_columns)) == want
    if same_columns:
        counted = Observation()
        again = enrich.merge_extracted(df, legacy_string=legacy_string, counted=counted)
        assert again.schema == merged.schema and repr(rows(again)) == repr(rows(merged))
        assert rows(quality.observed_report(spark, counted)) == want
    assert rows(enrich.merge_report(df.limit(0))) == [(0, 0, 0, 0.0)]
    plan = enrich.merge_report(df)._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1


def test_raw_to_gold(spark):
    raw = spark.createDataFrame([
        (1, "u", 100.0, 2000, "ford", "FOCUS se", 5.0, None, TEXT),
        (2, "u", 0.0, 2000, "ford", "focus", 5.0, None, TEXT),
        (3, "u", 100.0, 2000, "bmw", "x5", 5.0, None, TEXT),
    ], "id long, url string, price double, year int, manufacturer string, model string, odometer double, fuel string, description string")
    names = models.dictionary_frame(spark, {"ford": ["focus"]})
    out = refine.gold(refine.silver(raw, fraction=1.0, key=["id"]), names)
    assert out.columns == ["price", "year", "manufacturer", "model", "odometer", "fuel"]
    assert rows(out) == [(100.0, 2000, "ford", "focus", 5.0, "gas")]


@pytest.mark.parametrize("step", ["rules", "merge"])
def test_no_python_outside_the_udf(spark, step):
    df = spark.createDataFrame([(1, None, TEXT)], "id int, fuel string, description string")
    out = enrich.extract_fields_rules(df)
    out = enrich.merge_extracted(out) if step == "merge" else out
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_merge_runs_one_rule_per_cell(spark):
    df = spark.createDataFrame([(1, None, TEXT)], "id int, fuel string, description string")
    plan = enrich.merge_extracted(enrich.extract_fields_rules(df.repartition(2))).select("fuel")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_refresh_tables(spark, tmp_path):
    from forecourt.sources.files import write_csv
    from forecourt.sources.repair_prices import default_repair_catalog

    told = {"id": 1, "price": 100.0, "year": 2000, "manufacturer": "ford", "model": "Focus se", "odometer": 5.0, "description": TEXT}
    cars = spark.createDataFrame(
        [tuple({**told, "id": i}.get(f) for f in S.LISTING.names) for i in range(3)], S.LISTING
    )
    write_csv(cars, str(tmp_path / "cars"))
    write_csv(default_repair_catalog(spark), str(tmp_path / "repairs"))
    report = refine.refresh_tables(
        spark, "car_sales_test", str(tmp_path / "cars"), str(tmp_path / "repairs"), fraction=1.0, key=["id"]
    )
    assert tuple(report.first()) == (21, 3, 18, 85.71)
    gold = spark.table("car_sales_test.vehicles_enriched")
    assert gold.count() == 3 and {r["model"] for r in gold.collect()} == {"focus"}
    assert {r["fuel"] for r in gold.collect()} == {"gas"} and "description" not in gold.columns
    assert spark.table("car_sales_test.reparations").count() == 99
    assert spark.table("car_sales_test.vehicles").columns == S.LISTING.names
