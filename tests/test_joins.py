import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from forecourt.plans.joins import contains_join, fits_broadcast, keyed_join, materialize


def hot_tables(spark):
    rng = random.Random(3)
    facts = [("hot" if i % 3 == 0 else rng.choice("abcdef"), i) for i in range(900)] + [(None, -1)] * 5
    dims = [("hot", n) for n in range(7)] + [("a", 1), ("a", 2), ("b", 3), ("none", 4), (None, 5)]
    fact = spark.createDataFrame(facts, "k string, f int").repartition(5)
    return fact, spark.createDataFrame(dims, "k string, d int")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("rows_per_task", [1, 10, 250, 10_000])
def test_salted_join_equals_plain_join(spark, how, rows_per_task):
    fact, dim = hot_tables(spark)
    plain = fact.join(dim, ["k"], how)
    salted = keyed_join(fact, dim, ["k"], how, max_rows=0, rows_per_task=rows_per_task)
    assert rows(salted) == rows(plain)
    assert rows(keyed_join(fact, dim, ["k"], how)) == rows(plain)


def test_hot_key_is_spread_over_tasks(spark):
    fact = spark.range(4000, numPartitions=8).select(F.lit("hot").alias("k"), "id")
    dim = spark.createDataFrame([("hot", 1)], "k string, d int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = keyed_join(fact, dim, ["k"], max_rows=0, rows_per_task=100)
        per_task = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in per_task) == 4000
    assert max(r["count"] for r in per_task) < 2500


def test_broadcast_only_below_the_bound(spark):
    fact, dim = hot_tables(spark)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(keyed_join(fact, dim, ["k"]))
    assert fits_broadcast(dim, max_rows=12) and not fits_broadcast(dim, max_rows=11)
    assert not fits_broadcast(dim, max_bytes=20)


def test_sizes_are_counted_without_a_limit(spark, monkeypatch):
    df = spark.range(50).repartition(5)
    limit, asked = type(df).limit, []
    monkeypatch.setattr(type(df), "limit", lambda self, n: asked.append(n) or limit(self, n))
    assert fits_broadcast(df, max_rows=50) and not fits_broadcast(df, max_rows=49) and fits_broadcast(df.filter("id < 0"), max_rows=0)
    assert max(asked, default=1) == 1  # the row of counts; a limit of the table would send its rows to one task


def test_contains_join_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc %_é'") for _ in range(n))
    needles = sorted({word(rng.randint(0, 5)) for _ in range(150)} | {"", "a", "é"})
    texts = sorted({word(rng.randint(0, 12)) for _ in range(200)} | {""})
    found = contains_join(
        spark.createDataFrame([(n,) for n in needles] + [(None,)], "needle string"),
        spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"),
        "needle", "text",
    )
    assert rows(found.select("needle", "text")) == sorted(((n, t) for n in needles for t in texts if n in t), key=repr)


def test_contains_join_keeps_spaces_apart(spark):
    needles = spark.createDataFrame([("a", "ring"), ("b", "ring")], "side string, needle string")
    texts = spark.createDataFrame([("a", "red ring"), ("b", "rod"), ("c", "ring")], "side string, text string")
    assert rows(contains_join(needles, texts, "needle", "text", on=("side",)).select("side", "needle", "text")) == [
        ("a", "ring", "red ring")
    ]


def test_contains_join_compares_no_full_product(spark):
    needles = spark.createDataFrame([("ring",)], "needle string")
    texts = spark.createDataFrame([("red ring",)], "text string")
    plan = contains_join(needles, texts, "needle", "text")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_postings_grow_with_the_needles_grams_only(spark, monkeypatch):
    """A text is posted by number under grams that some needle has, so a longer text costs no more."""
    from forecourt.plans import joins

    stored = []
    keep = joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df: stored.append(keep(df)) or stored[-1])
    needles = spark.createDataFrame([("ring",)], "needle string")
    sizes = []
    for words in (10, 1000):
        stored.clear()
        texts = spark.createDataFrame([("red ring " + " ".join(f"w{i}" for i in range(words)),)], "text string")
        assert contains_join(needles, texts, "needle", "text").count() == 1
        sizes += [t.count() for t in stored if t.columns == ["_gram", "_text_id"] or set(t.columns) == {"_gram", "_text_id"}]
    assert sizes == [2, 2]


def test_broadcast_takes_a_small_part_of_the_drivers_heap(spark):
    rows = spark._jvm.java.lang.Runtime.getRuntime().maxMemory() // 1000  # of about 100 bytes each in a hashed relation
    assert not fits_broadcast(spark.range(rows).selectExpr("id", "id AS a", "id AS b", "id AS c", "id AS d"), max_rows=rows)
    assert fits_broadcast(spark.range(rows // 100).selectExpr("id", "id AS a", "id AS b", "id AS c", "id AS d"))


def test_packed_and_repeated_rows_are_not_broadcast_unasked(spark):
    packed = materialize(spark.range(200).selectExpr("id % 20 AS k", "id AS d")).withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(50))))
    joined = keyed_join(spark.range(100).selectExpr("id % 20 AS k", "id AS f"), packed, ["k"], max_rows=1000)
    assert joined.count() == 100 * 10 * 50
    joined.collect()
    assert not re.search(r"BroadcastHashJoin \[[^\]]*_salt", joined._jdf.queryExecution().executedPlan().toString())


def test_short_and_empty_needles_are_split(spark):
    texts = spark.range(400).selectExpr("concat('a', id) AS text")
    needles = spark.createDataFrame([("",), ("a",)], "needle string")
    assert contains_join(needles, texts, "needle", "text").count() == 800


def test_materialize_cuts_lineage(spark):
    stored = materialize(spark.range(10).selectExpr("id * 2 AS x"))
    assert spark.conf.get("spark.checkpoint.dir")
    assert stored.agg(F.sum("x")).first()[0] == 90
    assert "Range" not in stored._jdf.queryExecution().optimizedPlan().toString()


def test_key_that_is_hot_on_both_sides(spark):
    fact = spark.range(300).selectExpr("'hot' AS k", "id AS f").repartition(4)
    dim = spark.range(200).selectExpr("IF(id < 150, 'hot', 'cold') AS k", "id AS d").repartition(3)
    joined = keyed_join(fact, dim, ["k"], max_rows=0, rows_per_task=500)
    assert joined.count() == 300 * 150
    assert joined.distinct().count() == 300 * 150


def test_scratch_deletes_what_nothing_reads(spark):
    import os

    from forecourt.plans.joins import is_stored, scratch

    at = lambda df: df._stored_at.removeprefix("file:")
    with scratch(spark) as keep:
        gone = materialize(spark.range(3))
        with scratch(spark) as keep_inner:
            inner, lost = keep_inner(materialize(spark.range(4))), materialize(spark.range(5))
        assert os.path.isdir(at(inner)) and not os.path.isdir(at(lost))
        kept = keep(materialize(spark.range(2)))
    assert not os.path.isdir(at(gone)) and not os.path.isdir(at(inner)) and kept.count() == 2
    assert is_stored(kept.filter("id > 0").select("id")) and not is_stored(kept.distinct())
