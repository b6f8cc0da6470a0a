import json
import subprocess
import sys

import pytest
from pyspark.sql import types as T
from pyspark.sql import functions as F

from conftest import rows
from forecourt import schemas as S
from forecourt.functions import replies
from forecourt.operators import adhoc, conversations
from forecourt.operators.advise import advise, request_readiness
from forecourt.sources import files, tables
from forecourt.sources.repair_prices import default_repair_catalog


def test_csv_keeps_line_breaks_quotes_and_blanks(spark, tmp_path):
    texts = ["one\ntwo", 'a "quoted", word', " blanks ", "back\\slash", None, "plain"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, description string")
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in S.LISTING if f.name not in df.columns]
    files.write_csv(df.select("*", *absent).select(*S.LISTING.names), str(tmp_path / "cars"))
    back = files.read_listings(spark, str(tmp_path / "cars"))
    assert back.schema == S.LISTING
    assert rows(back.select("id", "description")) == rows(df)


def test_inferred_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,year,price\n1,2014,9.5\n2,,3\n")
    inferred = files.read_listings(spark, str(tmp_path / "x.csv"), schema=None)
    assert [f.dataType.simpleString() for f in inferred.schema] == ["int", "int", "double"]


def test_repair_catalog_round_trip(spark, tmp_path):
    prices = default_repair_catalog(spark)
    files.write_csv(prices, str(tmp_path / "prices"), files=1)
    assert len(list((tmp_path / "prices").glob("*.csv"))) == 1
    assert rows(files.read_repair_catalog(spark, str(tmp_path / "prices"))) == rows(prices)


def test_file_inventory(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * 1024 * 1024)
    (tmp_path / "b.csv").write_bytes(b"x" * 512 * 1024)
    assert rows(files.file_inventory(spark, str(tmp_path), "*.csv")) == sorted([
        ("a.csv", 1048576, "1.00 MB"), ("b.csv", 524288, "0.50 MB"), (None, 1572864, "0.00 GB"),
    ], key=repr)


def test_tables_are_replaced(spark):
    tables.ensure_schema(spark, "market_test")
    tables.write_table(spark.range(3), "market_test.t")
    assert tables.write_table(spark.range(2), "market_test.t").count() == 2
    assert tables.read_table(spark, "market_test.t").count() == 2
    assert tables.schema_text(spark, "market_test.t") == "market_test.t(id bigint)"
    assert tables.schema_text(spark, "market_test.none").startswith("market_test.none cannot be read (")
    assert rows(tables.describe_schema(spark.table("market_test.t"))) == [(0, "id", "bigint")]


def envelope(text):
    return json.dumps([{"type": "reasoning", "summary": []}, {"type": "text", "text": text}])


def test_parse_reply(spark):
    data = [(1, envelope('{"model": "civic", "year": 2019}')), (2, "junk"), (3, None), (4, envelope("no json")), (5, "[]")]
    df = spark.createDataFrame(data, "id int, reply string").select("id", replies.parse_reply(F.col("reply")).alias("r"))
    assert rows(df.select("id", "r.model", "r.year")) == [
        (1, "civic", "2019"), (2, None, None), (3, None, None), (4, None, None), (5, None, None)
    ]


def test_parse_dictionary(spark):
    good = envelope('{"toyota": ["corolla", "yaris"], "chevrolet": ["silverado"]}')
    df = spark.createDataFrame([(good,)], "reply string")
    assert rows(replies.parse_dictionary(df)) == [("chevrolet", 0, "silverado"), ("toyota", 0, "corolla"), ("toyota", 1, "yaris")]
    bad = spark.createDataFrame([("sorry",)], "reply string")
    assert rows(replies.parse_dictionary(bad)) == []
    with pytest.raises(Exception, match="not a model dictionary"):
        replies.parse_dictionary(bad, strict=True).collect()


def test_normalize_reply(spark):
    shapes = {
        "plain text": "plain text",
        '{"content": "hello"}': "hello",
        '{"messages": [{"type": "human", "content": "q"}, {"type": "ai", "content": "a"}, {"type": "human", "content": "z"}]}': "a",
        '{"messages": [{"role": "user", "content": "q"}, {"role": "tool"}], "content": "c"}': "q",
        '{"messages": [], "content": "c"}': "c",
        '{"other": 1}': '{"other": 1}',
    }
    df = spark.createDataFrame([(k,) for k in shapes], "reply string")
    assert rows(df.select("reply", replies.normalize_reply(F.col("reply")))) == sorted(shapes.items(), key=repr)


TURNS = "conv_id int, turn long, role string, text string"


def test_broken_records_are_quarantined(spark, tmp_path):
    good = ['1,ok,10,2000', '2,"two\nlines, and ""quotes""",11.5,2001', '3,,,']
    broken = ['x,ok,10,2000', '5,ok,dear,soon', '6,ok', '7,ok,1,2000,more']
    for name, lines in (("a", good[:2] + broken[:2]), ("b", good[2:] + broken[2:]), ("c", [])):
        (tmp_path / f"{name}.csv").write_text("\n".join(["id,note,price,year", *lines]) + "\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("note", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("year", T.IntegerType())])
    cars, bad = files.read_with_quarantine(spark, str(tmp_path), schema)
    assert rows(cars) == [(1, "ok", 10.0, 2000), (2, 'two\nlines, and "quotes"', 11.5, 2001), (3, None, None, None)]
    assert (cars.count(), bad.count()) == (3, 4)
    told = {r["record"]: (r["file"][-5:], r["reason"]) for r in bad.collect()}
    assert told == {
        broken[0]: ("a.csv", "id"), broken[1]: ("a.csv", "price, year"), broken[2]: ("b.csv", "number of fields"), broken[3]: ("b.csv", "number of fields"),
    }


def test_conversations(spark):
    turns = spark.createDataFrame([
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "z"), (2, 0, "user", "only"), (2, 1, "assistant", None),
    ], TURNS)
    new = spark.createDataFrame([(1, "next"), (1, "after"), (3, "first")], "conv_id int, text string")
    history = conversations.conversation_history(turns, new)
    assert [tuple(r) for r in history.collect()] == [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "z"), (1, 3, "user", "after"), (1, 4, "user", "next"),
        (2, 0, "user", "only"), (2, 1, "assistant", None), (3, 0, "user", "first"),
    ]
    assert rows(conversations.last_reply(turns)) == [(1, "a"), (2, "only")]


READS = [
    "SELECT 1", "select * from v where note = 'please DROP and update'", "WITH a AS (SELECT 1 AS x) SELECT x FROM a",
    "SELECT model AS Limited FROM v", "TABLE v", "VALUES (1)", "SELECT id FROM v UNION SELECT 2 INTERSECT SELECT 3",
    "SELECT count(*) FROM v GROUP BY id HAVING count(*) > 0 ORDER BY 1 LIMIT 3 OFFSET 0", "SELECT (SELECT max(id) FROM v)",
    "SELECT id, sum(id) OVER w FROM v WINDOW w AS (ORDER BY id)", "SELECT * FROM v LATERAL VIEW explode(array(1, 2)) t AS e",
    "SELECT * FROM range(3)", "SELECT a.id FROM v a JOIN v b ON a.id = b.id", "FROM v |> WHERE id = 1",
    "SELECT upper(model), transform(array(id), x -> x + 1), uuid() FROM v", "SELECT * FROM explode(array(1))",
    "WITH a AS (SELECT 1 AS x), b AS (SELECT x FROM a) SELECT * FROM b WHERE x IN (SELECT x FROM a)",
]
WRITES = [
    "DROP TABLE v", "INSERT INTO v SELECT 1", "WITH a AS (SELECT 1) INSERT INTO v SELECT * FROM a", "DELETE FROM v",
    "UPDATE v SET id = 1", "MERGE INTO v USING v s ON v.id = s.id WHEN MATCHED THEN DELETE", "CREATE TABLE t AS SELECT 1",
    "ALTER TABLE v ADD COLUMN x INT", "TRUNCATE TABLE v", "SET a = b", "EXECUTE IMMEDIATE 'DROP TABLE v'",
    "BEGIN DROP TABLE v; END", "SELECT TRANSFORM(id) USING 'cat' FROM v", "SELECT (SELECT TRANSFORM(id) USING 'cat' FROM v)",
    "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1", "FROM v INSERT INTO t SELECT 1 INSERT INTO u SELECT 2",
    "SELECT reflect('java.lang.System', 'setProperty', 'x.y', 'z')", "SELECT id FROM v WHERE java_method('java.util.UUID', 'randomUUID') > ''",
    "SELECT (SELECT max(try_reflect('java.lang.Math', 'abs', id)) FROM v)", "CACHE TABLE v", "CREATE VIEW w AS SELECT 1", "DECLARE x INT", "WITH a AS (SELECT TRANSFORM(id) USING 'cat' FROM v) SELECT * FROM a",
]

# What no list of bad names finds: names made at run time, files as tables, functions and views of others.
REACHES = [
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'setProperty', 'x.y', 'z')", "SELECT IDENTIFIER('up' || 'per')(model) FROM v",
    "SELECT * FROM IDENTIFIER('v')", "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM parquet.`/x`", "SELECT * FROM binaryFile.`/etc`",
    "WITH a AS (SELECT * FROM text.`/etc/hostname`) SELECT * FROM a", "SELECT (SELECT max(value) FROM text.`/etc/hostname`)",
    "SELECT id FROM v WHERE note IN (SELECT value FROM csv.`/etc/hostname`)", "SELECT v.id FROM v JOIN json.`/etc/hostname` ON true",
    "SELECT java_method('java.util.UUID', 'randomUUID')", "WITH a AS (SELECT `reflect`('java.lang.Math', 'abs', 1)) SELECT * FROM a",
    "VALUES (reflect('java.lang.Math', 'abs', 1))", "SELECT input_file_name() FROM v", "SELECT from_protobuf(unbase64(note), 'x', '/etc/hostname') FROM v",
    "SELECT own_function(id) FROM v", "SELECT no_such_function(id) FROM v", "SELECT spark_catalog.default.upper(note) FROM v",
    "SELECT * FROM python_worker_logs()", "SELECT * FROM v LATERAL VIEW own_function(id) t AS e", "SELECT count(*) FROM no_such.table_of_it",
    "FROM v |> WHERE id = IDENTIFIER('reflect')('java.lang.Math', 'abs', 1)",
]


@pytest.fixture
def view(spark):
    spark.udf.register("own_function", lambda x: x, "long")
    spark.createDataFrame([(1, "x", "civic")], "id long, note string, model string").createOrReplaceTempView("v")


@pytest.mark.parametrize("text", READS)
def test_queries_run(spark, view, text):
    adhoc.run_readonly_sql(spark, text + " ;").collect()


@pytest.mark.parametrize("text", WRITES)
def test_writes_are_refused(spark, view, text):
    with pytest.raises(adhoc.NotReadOnly):
        adhoc.run_readonly_sql(spark, text)


@pytest.mark.parametrize("text", REACHES)
def test_what_reaches_out_is_refused(spark, view, text):
    with pytest.raises(adhoc.NotReadOnly):
        adhoc.check_readonly(spark, text)
    assert spark._jvm.java.lang.System.getProperty("x.y") is None


def test_own_functions_under_known_names_are_refused(spark):
    other = spark.newSession()
    adhoc.check_readonly(other, "SELECT soundex('a')")
    other.udf.register("soundex", lambda x: x)
    with pytest.raises(adhoc.NotReadOnly):
        adhoc.check_readonly(other, "SELECT soundex('a')")


def test_only_the_given_tables_are_read(spark, view):
    spark.sql("CREATE SCHEMA IF NOT EXISTS shop")
    spark.createDataFrame([(1,)], "id long").write.mode("overwrite").saveAsTable("shop.sales")
    spark.sql("CREATE OR REPLACE VIEW shop.seen AS SELECT id FROM shop.sales")
    spark.createDataFrame([(1,)], "id long").createOrReplaceTempView("w")
    allowed = {
        "SELECT id FROM shop.sales": (["shop"], ["shop.sales"], ["spark_catalog"], ["spark_catalog.shop"], ["SHOP.Sales", "v"]),
        "SELECT id FROM shop.seen": (["shop.seen"], ["shop"]),
        "SELECT v.id FROM v JOIN spark_catalog.shop.sales s ON v.id = s.id": (["v", "shop"],),
        "WITH w AS (SELECT id FROM v) SELECT * FROM w": (["v"],),
        "SELECT * FROM range(2)": ([],),
    }
    refused = {
        "SELECT id FROM shop.sales": ([], ["v"], ["sales"], ["shop.seen"], ["spark"]),
        "SELECT id FROM shop.seen": (["shop.sales"],),
        "SELECT v.id FROM v WHERE id IN (SELECT id FROM shop.sales)": (["v"], ["shop"]),
        "WITH a AS (SELECT id FROM w) SELECT 1 FROM v": (["v"],),
        "SELECT id FROM w UNION ALL SELECT id FROM v": (["v"],),
    }
    for text, lists in allowed.items():
        for relations in lists:
            adhoc.run_readonly_sql(spark, text, relations=relations).collect()
    for text, lists in refused.items():
        for relations in lists:
            with pytest.raises(adhoc.NotReadOnly):
                adhoc.check_readonly(spark, text, relations=relations)
    spark.sql("DROP VIEW shop.seen")
    spark.sql("DROP TABLE shop.sales")


def test_envelopes_keep_the_order_of_the_text(spark):
    ids = lambda text, cap: [r["id"] for r in json.loads(adhoc.answer_sql(spark, text, cap))["data"]]
    assert ids("SELECT id % 10 AS a, id FROM range(1000) ORDER BY id DESC", 3) == [999, 998, 997]
    assert ids("SELECT id % 10 AS a, id FROM range(1000)", 3) == [0, 10, 20]
    assert ids("SELECT id FROM range(1000) ORDER BY id % 7 DESC, id LIMIT 2", 5) == [6, 13]
    assert ids("WITH t AS (SELECT id FROM range(50)) SELECT id FROM t ORDER BY -id OFFSET 1", 2) == [48, 47]
    assert ids("SELECT id FROM (SELECT id FROM range(9) ORDER BY id DESC) AS t", 2) == [8, 7]
    told = json.loads(adhoc.answer_sql(spark, "SELECT id FROM range(1000) ORDER BY id DESC", 4))
    assert (told["row_count"], told["total_rows"], told["truncated"]) == (4, 1000, True)
    assert ids("SELECT id, map(1, 2) AS m FROM range(5) WHERE id > 3", 3) == [4]


def test_cap_and_parameters(spark):
    assert adhoc.run_readonly_sql(spark, "SELECT * FROM range(500) LIMIT 300").count() == 300
    assert adhoc.run_readonly_sql(spark, "SELECT * FROM range(500)", cap=100).count() == 100
    assert rows(adhoc.run_readonly_sql(spark, "SELECT :t AS t", args={"t": "won't start"})) == [("won't start",)]


def test_envelope(spark):
    told = json.loads(adhoc.answer_sql(spark, "SELECT id FROM range(3)"))
    assert told == {"found": True, "data": [{"id": 0}, {"id": 1}, {"id": 2}], "row_count": 3, "total_rows": 3, "truncated": False}
    many = json.loads(adhoc.answer_sql(spark, "SELECT 999 - id AS x FROM range(1000)"))
    assert (many["row_count"], many["total_rows"], many["truncated"], many["data"][0]) == (100, 1000, True, {"x": 0})
    none = json.loads(adhoc.answer_sql(spark, "SELECT id FROM range(0)"))
    assert (none["found"], none["data"]) == (False, []) and none["message"]
    zero = json.loads(adhoc.answer_sql(spark, "SELECT count(*) AS num_cars_sold FROM range(0)"))
    assert (zero["found"], zero["data"]) == (False, [{"num_cars_sold": 0}])
    assert json.loads(adhoc.answer_sql(spark, "SELECT nothing FROM range(1)"))["error"]
    assert json.loads(adhoc.answer_sql(spark, "DROP TABLE v"))["error"]


REQUEST = ("request_id int, manufacturer string, model string, year int, condition string, odometer int, "
           "diagnosis string, components string")


def test_readiness_and_advice(spark):
    asked = spark.createDataFrame([
        (1, "toyota", "camry", 2020, "good", 50000, None, None),
        (2, "toyota", "camry", 2020, "good", 50000, None, "horn"),
        (3, "toyota", "camry", 2020, "good", 50000, "check engine light", None),
        (4, "toyota", " ", None, "good", 50000, None, "horn"),
        (5, "trabant", "601", 1980, "good", 50000, None, "horn"),
        (6, "toyota", "camry", 2020, "good", 50000, None, "teleporter"),
    ], REQUEST)
    cars = spark.createDataFrame(
        [("toyota", "camry", 2020, "good", 50000, p) for p in (9000.0, 10000.0, 14000.0)],
        "manufacturer string, model string, year int, condition string, odometer int, price double",
    )
    ready = {r["request_id"]: (r["ready"], r["missing"]) for r in request_readiness(asked).collect()}
    assert ready[1] == (True, []) and ready[4] == (False, ["model", "year"])
    told = {r["request_id"]: r for r in advise(asked, cars, default_repair_catalog(spark)).collect()}
    assert {k: r["strategy"] for k, r in told.items()} == {1: "list", 2: "fix_first", 3: "as_is", 4: "ask", 5: "no_market", 6: "no_repair_price"}
    assert (told[1]["base_value"], told[1]["list_price"], told[2]["list_price"]) == (11000.0, 11000.0, 10850.0)
    assert told[3]["repair_cost"] == 600 + 600 + 1500 + 250 + 150
    assert told[1]["price_low"] < 11000 < told[1]["price_high"]
    assert all(told[k][c] is None for k in (4, 5) for c in ("price_low", "price_high"))
    assert (told[4]["list_price"], told[4]["repair_cost"], told[5]["list_price"]) == (None, None, None)
    median = {r["request_id"]: r for r in advise(asked, cars, default_repair_catalog(spark), base="median").collect()}
    assert median[1]["list_price"] == 10000.0
    with pytest.raises(ValueError):
        advise(asked, cars, default_repair_catalog(spark), base="mode")


def test_import_starts_no_session():
    code = "import __spark_entry__; from pyspark.sql import SparkSession; assert SparkSession.getActiveSession() is None"
    root = __file__.rsplit("/tests/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
