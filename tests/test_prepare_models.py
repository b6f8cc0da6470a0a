import random
import pytest
from pyspark.sql import functions as F

from conftest import rows
from forecourt import schemas as S
from forecourt.operators import models, prepare

PAIR = "manufacturer string, model string"


def test_manufacturers_exact_and_not_null(spark):
    df = spark.createDataFrame([("ford",), ("Ford",), (None,), ("bmw",), ("honda",)], "manufacturer string")
    assert rows(prepare.filter_manufacturers(df)) == [("ford",), ("honda",)]
    assert rows(prepare.filter_manufacturers(df, ["bmw"])) == [("bmw",)]


def test_valid_rows(spark):
    df = spark.createDataFrame([
        (1, 0.0, 2000, "a", 1), (2, None, 2000, "a", 1), (3, -5.0, 2000, "a", 1), (4, 9.0, None, "a", 1),
        (5, 9.0, 2000, None, 1), (6, 9.0, 2000, "a", None), (7, 9.0, 2000, "", 0),
    ], "id int, price double, year int, model string, odometer int")
    assert [r["id"] for r in prepare.filter_valid(df).orderBy("id").collect()] == [3, 7]


def test_drop_ignores_absent_columns(spark):
    df = spark.createDataFrame([(1, "x", "y")], "id int, url string, VIN string")
    assert prepare.drop_columns(df).columns == ["id"]


def test_hash_sample_is_the_same_for_any_partitioning(spark):
    df = spark.range(20000)
    one = prepare.sample_rows(df, 0.1, key=["id"])
    other = prepare.sample_rows(df.repartition(13), 0.1, key=["id"])
    assert rows(one) == rows(other)
    assert 1800 < one.count() < 2200
    assert prepare.sample_rows(df, 1.0, key=["id"]).count() == 20000


def test_seeded_sample_repeats(spark):
    df = spark.range(5000)
    assert rows(prepare.sample_rows(df, 0.05, seed=1)) == rows(prepare.sample_rows(df, 0.05, seed=1))


def test_stage_counts(spark):
    counted = prepare.stage_counts(spark.range(10), {"all": F.lit(True), "even": F.col("id") % 2 == 0, "big": F.col("id") > 5})
    assert rows(counted) == [(0, "all", 10), (1, "even", 5), (2, "big", 2)]


def test_distinct_models_and_counts(spark):
    df = spark.createDataFrame([
        ("toyota", "camry"), ("toyota", "camry"), ("ford", "mustang"), ("ford", "f-150"), ("ford", "mustang"),
        (None, "x"), ("ford", None),
    ], PAIR)
    assert [tuple(r) for r in models.distinct_models(df).collect()] == [("ford", "f-150"), ("ford", "mustang"), ("toyota", "camry")]
    assert [tuple(r) for r in models.model_counts(df).collect()] == [("toyota", "camry", 2), ("ford", "mustang", 2), ("ford", "f-150", 1)]


def renamed(spark, data, names, **options):
    df = spark.createDataFrame(data, PAIR)
    out = models.normalize_models(df, models.dictionary_frame(spark, names), **options)
    assert out.columns == df.columns
    return rows(out)


@pytest.mark.parametrize("max_rows", [1000, 0])
def test_variants_become_the_canonical_name(spark, max_rows):
    data = [("toyota", "Camry LE"), ("toyota", "CAMRY XSE"), ("ford", "camry look-alike"), ("toyota", "rav4"),
            ("Toyota", "camry le"), (None, "camry le"), ("toyota", None)]
    assert renamed(spark, data, {"toyota": ["camry"]}, max_rows=max_rows) == sorted([
        ("toyota", "camry"), ("toyota", "camry"), ("ford", "camry look-alike"), ("toyota", "rav4"),
        ("Toyota", "camry le"), (None, "camry le"), ("toyota", None),
    ], key=repr)


def test_names_apply_in_order_to_the_rewritten_value(spark):
    data = [("chevrolet", "SILVERADO 1500 crew"), ("chevrolet", "silverado 2500")]
    assert renamed(spark, data, {"chevrolet": ["silverado 1500", "silverado"]}) == [("chevrolet", "silverado")] * 2
    assert renamed(spark, data, {"chevrolet": ["silverado", "silverado 1500"]}) == [("chevrolet", "silverado")] * 2


def test_special_characters_are_literal_unless_regex(spark):
    data = [("ford", "f-150+ xl"), ("ford", "f-1500"), ("chrysler", "town & country (lx)")]
    names = {"ford": ["f-150+"], "chrysler": ["(lx)"]}
    assert renamed(spark, data, names) == [("chrysler", "(lx)"), ("ford", "f-150+"), ("ford", "f-1500")]
    assert renamed(spark, data, {"ford": ["f-150+"]}, mode="regex")[1:] == [("ford", "f-150+"), ("ford", "f-150+")]
    with pytest.raises(ValueError):
        renamed(spark, data, names, mode="glob")


def fold(model, names):
    """Names applied one after the other, the plain way."""
    for name in names:
        model = name if model is not None and name.lower() in model.lower() else model
    return model


@pytest.mark.parametrize("max_rows", [100_000, 0])
def test_chains_of_names_equal_the_fold(spark, max_rows):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abAB ") for _ in range(rng.randint(0, 5)))
    names = {m: [word() for _ in range(rng.randint(1, 25))] for m in ("x", "y", "z")}
    data = [(rng.choice(["x", "y", "z", "w", None]), rng.choice([None, word() + word() + word()])) for _ in range(300)]
    assert renamed(spark, data, names, max_rows=max_rows) == sorted(((m, fold(v, names.get(m, []))) for m, v in data), key=repr)


def test_a_maker_with_many_names(spark):
    names = spark.range(100_000).selectExpr("'ford' AS manufacturer", "CAST(id AS int) AS pos", "concat('m', id, IF(id % 2 = 0, ' gt', '')) AS canonical")
    df = spark.range(0, 100_000, 997).selectExpr("'ford' AS manufacturer", "concat('M', id, ' GT line') AS model", "id")
    out = {r["id"]: r["model"] for r in models.normalize_models(df, names).collect()}
    for i, model in out.items():
        # Prefixes of the number are names too: the first one in order is the shortest, of one digit if it is odd.
        first = next(f"m{p}" + ("" if int(p) % 2 else " gt") for n in range(1, len(str(i)) + 1) for p in [str(i)[:n]] if int(p) % 2 or p == str(i))
        assert model == first


def test_base_names_of_several_words(spark):
    variants = {
        "jeep": ["Grand Cherokee Laredo"] * 3 + ["grand  cherokee limited 4x4", "grand cherokee", "wrangler sport", "wrangler", "compass", "compass"],
        "chevrolet": ["silverado 1500", "Silverado 1500 lt", "silverado 2500hd", "malibu lt", "malibu ls", "corvette z06 coupe", "odd one"],
        "ford": ["f-150 xlt", "F-150 lariat", "f-150", "", "  "],
    }
    df = spark.createDataFrame([(m, v) for m, listed in variants.items() for v in listed] + [(None, "x y"), ("ford", None)], PAIR)
    found = models.propose_base_names(df)
    assert rows(found.select("manufacturer", "canonical", "n")) == [
        ("chevrolet", "malibu", 2), ("chevrolet", "silverado", 3), ("ford", "f-150", 3),
        ("jeep", "compass", 2), ("jeep", "grand cherokee", 5), ("jeep", "wrangler", 2),
    ]
    out = models.normalize_models(df, found)
    assert {r["model"] for r in out.filter("manufacturer = 'jeep'").collect()} == {"grand cherokee", "grand  cherokee limited 4x4", "wrangler", "compass"}
    assert models.propose_base_names(df.limit(0)).collect() == []


def test_normalizing_twice_changes_nothing(spark):
    names = models.dictionary_frame(spark, {"toyota": ["camry", "corolla"]})
    df = spark.createDataFrame([("toyota", "camry le"), ("toyota", "corolla 4dr"), ("toyota", "yaris")], PAIR)
    once = models.normalize_models(df, names)
    assert rows(models.normalize_models(once, names)) == rows(once)


def test_proposed_dictionary(spark):
    data = [("toyota", "Corolla 4dr")] * 3 + [("toyota", "corolla"), ("toyota", "yaris 2wd"), ("toyota", "yaris"), ("toyota", "odd one")]
    df = spark.createDataFrame(data, PAIR)
    assert rows(models.propose_dictionary(df)) == [("toyota", 0, "corolla", 4), ("toyota", 1, "yaris", 2)]
    assert rows(models.propose_dictionary(df, min_count=3)) == [("toyota", 0, "corolla", 4)]


def test_fixed_values():
    assert S.TARGET_MANUFACTURERS == ["ford", "toyota", "chevrolet", "honda"]
    assert len(S.COLUMNS_TO_DROP) == 12 and S.SAMPLE_FRACTION == 0.01
    assert len(S.EXTRACTED.names) == 11
