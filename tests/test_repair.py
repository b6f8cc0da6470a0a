import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from forecourt.functions.text import coerce_components
from forecourt.operators.repair import match_repairs, repair_estimate, repairs_for, request_term_sets
from forecourt.sources.repair_prices import default_repair_catalog

REQUEST = "request_id int, diagnosis string, components array<string>"
CATALOG = "component string, diagnostic string, reparation_cost int"


@pytest.fixture(scope="module")
def prices(spark):
    return default_repair_catalog(spark)


def test_shipped_price_list(prices):
    told = prices.agg(
        F.count("*"), F.countDistinct("component"), F.min("reparation_cost"), F.max("reparation_cost"),
        F.sum("reparation_cost"), F.count_if(F.col("reparation_cost") < 300),
    ).first()
    assert tuple(told) == (99, 99, 20, 3500, 54630, 39)


def names(df):
    return sorted(r["component"] for r in df.collect())


def test_both_columns_are_searched(prices):
    found = names(repairs_for(prices, components=["transmission"]))
    assert found == ["Clutch Kit", "Transmission Fluid", "Transmission Rebuild", "Transmission Solenoid"]


def test_components_or_diagnosis(prices):
    assert names(repairs_for(prices, "squeaking noise", [" Brake Rotors "])) == ["Brake Pads (Front)", "Brake Rotors"]
    assert names(repairs_for(prices, components="horn")) == ["Horn"]


def test_apostrophe(prices):
    assert names(repairs_for(prices, "failure won't move")) == ["Transmission Rebuild"]


def test_no_input_matches_all_and_cap(prices):
    assert repairs_for(prices).count() == 99
    assert names(repairs_for(prices, cap=2)) == ["ABS Control Module", "AC Compressor"]


def test_wildcards_only_on_request(prices):
    assert names(repairs_for(prices, components=["a_s"])) == []
    assert "ABS Control Module" in names(repairs_for(prices, components=["a_s"], like_wildcards=True))


def test_coerce_components(spark):
    one = spark.createDataFrame([("battery",), (None,)], "components string")
    assert [r[0] for r in coerce_components(one).collect()] == [["battery"], None]
    listed = spark.createDataFrame([(["a", "b"],)], "components array<string>")
    assert coerce_components(listed) is listed


def test_fallback_to_words(spark, prices):
    asked = spark.createDataFrame([
        (1, None, ["horn"]),
        (2, None, ["muffler bearings"]),
        (3, "xyzzy", None),
        (4, None, None),
    ], REQUEST)
    found = {r["request_id"]: r for r in repair_estimate(asked, prices, list_rows=50).collect()}
    assert (found[1]["relax_tier"], found[1]["total_estimated_cost"], found[1]["num_repairs"]) == (0, 150.0, 1)
    assert (found[2]["relax_tier"], found[2]["total_estimated_cost"]) == (1, 300.0)
    assert (found[3]["relax_tier"], found[3]["total_estimated_cost"], found[3]["identified_repairs"]) == (None, None, None)
    assert (found[4]["total_estimated_cost"], found[4]["num_repairs"], len(found[4]["identified_repairs"])) == (54630.0, 99, 50)
    plain = {r["request_id"]: r for r in repair_estimate(asked, prices, min_word=None).collect()}
    assert plain[2]["total_estimated_cost"] is None
    assert (found[4]["truncated"], found[1]["truncated"], "identified_repairs" in plain[1]) == (True, False, False)


def brute_force(diagnosis, components, catalog, min_word):
    terms = [c.strip().lower() for c in components or [] if c is not None] + ([diagnosis.strip().lower()] if diagnosis else [])
    texts = lambda row: [t.lower() for t in row[:2] if t is not None]
    search = lambda wanted: [row for row in catalog if any(w in t for w in wanted for t in texts(row))]
    if not terms:
        return 0, list(catalog)
    found = search(terms)
    if found:
        return 0, found
    found = search([w for t in terms for w in t.split() if len(w) >= min_word])
    return (1, found) if found else (None, [])


def test_batch_equals_brute_force(spark):
    rng = random.Random(2)
    maybe = lambda value: None if rng.random() < 0.15 else value
    words = ["brake", "pads", "oil", "leak", "Motor", "%", "o_l", "it's"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    catalog = [(maybe(text()), maybe(text()), maybe(rng.randint(10, 14))) for _ in range(150)] + [(None, None, 5), ("oil", "leak", 7), ("oil", "leak", 7)]
    asked = [
        (i, maybe(rng.choice(["", "  ", "Brake Pads", "leak now", "rubbish", text()])),
         maybe(rng.choice([[], [""], ["oil", None], ["brake", "Brake "], ["pads oil brake leak"], [text(), text()]])))
        for i in range(120)
    ]
    requests, prices = spark.createDataFrame(asked, REQUEST), spark.createDataFrame(catalog, CATALOG)
    order = lambda row: [(v is not None, v) for v in row]
    expected = []
    for key, diagnosis, components in asked:
        rung, found = brute_force(diagnosis, components, catalog, 4)
        total = float(sum(r[2] or 0 for r in found)) if found else None
        expected.append((key, rung, total, len(found), sorted(found, key=order)[:50] if found else None))
    got = [
        (r["request_id"], r["relax_tier"], r["total_estimated_cost"], r["num_repairs"],
         None if r["identified_repairs"] is None else [tuple(x) for x in r["identified_repairs"]])
        for r in repair_estimate(requests, prices, list_rows=50).collect()
    ]
    assert sorted(got) == sorted(expected)

    sets = request_term_sets(requests)
    assert match_repairs(requests, prices).select("term_set").distinct().count() <= sets.select("term_set").distinct().count()
    pairs = match_repairs(requests, prices).join(sets, "term_set").withColumn("n", F.explode(F.expr("sequence(1L, copies)"))).select(
        "request_id", "component", "diagnostic", "reparation_cost"
    )
    wanted = [(k, *row) for k, d, c in asked for rung, found in [brute_force(d, c, catalog, 99)] if rung == 0 for row in found]
    assert rows(pairs) == sorted(wanted, key=repr)


def test_commonest_words_are_given_up_first(spark):
    prices = spark.createDataFrame([
        ("Brake Pads", "grinding", 150), ("Front Bumper", "cracked", 400), ("Front Axle", "noise", 700), ("Front Lamp", "dark", 90), ("Horn", "silent", 50),
    ], CATALOG)
    asked = spark.createDataFrame([(1, "front brake pads worn", None), (2, "front worn", None), (3, None, ["silent front horn", "worn lamp"]), (4, "xyzzy worn", None)], REQUEST)
    found = rows(match_repairs(asked, prices, min_word=4, rarest=True).select("term_set", "relax_tier", "component"))
    assert found == sorted([
        ("front brake pads worn", 1, "Brake Pads"),
        ("front worn", 1, "Front Bumper"), ("front worn", 1, "Front Axle"), ("front worn", 1, "Front Lamp"),
        ("silent front horn; worn lamp", 1, "Horn"), ("silent front horn; worn lamp", 1, "Front Lamp"),
    ], key=repr)
    assert [r["num_repairs"] for r in repair_estimate(asked, prices).filter("request_id = 1").collect()] == [4]
    assert repair_estimate(asked, prices.limit(0), rarest=True).agg(F.sum("num_repairs")).first()[0] == 0


def test_rarest_words_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["brake", "pads", "front", "rear", "leak", "worn", "brakes", "100%"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    catalog = [(text(2) if rng.random() < 0.9 else None, text(1), rng.randint(10, 14)) for _ in range(60)]
    catalog += catalog[:5] + [(None, None, 3)]
    asked = [(i, "", [text(rng.randint(3, 6)) for _ in range(rng.randint(1, 2))]) for i in range(60)]
    holds = lambda row, word: any(word in t for t in row[:2] if t)
    total = len(catalog)

    def chosen(terms):
        exact = [row for row in catalog if any(holds(row, t) for t in terms)]
        if exact:
            return exact
        best = set()
        for term in terms:
            weight = {}
            for word in {w for w in term.split() if len(w) >= 4}:
                if n := sum(holds(row, word) for row in catalog):
                    weight[word] = max(1, round(math.log((total + 1) / n) * 1000))
            scores = [sum(w for word, w in weight.items() if holds(row, word)) for row in catalog]
            if max(scores) > 0:
                best |= {i for i, score in enumerate(scores) if score == max(scores)}
        return [catalog[i] for i in best]

    got = repair_estimate(spark.createDataFrame(asked, REQUEST), spark.createDataFrame(catalog, CATALOG), rarest=True).collect()
    expected = {key: [row[2] for row in chosen(terms)] for key, _, terms in asked}
    assert {r["request_id"]: (r["num_repairs"], r["total_estimated_cost"]) for r in got} == {
        key: (len(costs), float(sum(costs)) if costs else None) for key, costs in expected.items()}


def test_no_nested_loop_in_the_plan(spark, prices):
    asked = spark.createDataFrame([(1, None, ["horn"])], REQUEST)
    plan = match_repairs(asked, prices)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
