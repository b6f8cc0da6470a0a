"""Queries over replies and conversations."""

from pyspark.sql import functions as F

from forecourt import schemas as S
from forecourt.functions import replies
from forecourt.operators import conversations
from forecourt.workload.registry import query
from forecourt.workload.views import LISTINGS_SQL, listings, table


def _envelope(text):
    """Reply of a text service: reasoning block first, answer in the last block."""
    block = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("text"))
    return F.to_json(F.array(block("reasoning", F.lit("thinking")), block("text", text)))


@query(f"""WITH {LISTINGS_SQL}
SELECT id, CASE WHEN id % 5 <> 0 THEN manufacturer END AS manufacturer, CASE WHEN id % 5 <> 0 THEN model END AS model,
  CASE WHEN id % 5 <> 0 THEN CAST(year AS VARCHAR) END AS year, CASE WHEN id % 5 <> 0 THEN condition END AS condition
FROM listings""")
def parse_reply(spark, sf_dir):
    cars = listings(spark, sf_dir)
    answer = F.to_json(F.struct("manufacturer", "model", "year", "condition"))
    broken = F.when(F.col("id") % 10 == 0, _envelope(F.lit("no json {"))).otherwise(F.lit("Sorry, no answer"))
    told = cars.select("id", F.when(F.col("id") % 5 == 0, broken).otherwise(_envelope(answer)).alias("reply"))
    parsed = told.select("id", replies.parse_reply(F.col("reply")).alias("r"))
    return parsed.select("id", "r.manufacturer", "r.model", "r.year", "r.condition")


@query("""
SELECT p_partkey, p_brand AS manufacturer, CAST(unnest(range(len(string_split(p_name, ' ')))) AS INT) AS pos,
  unnest(string_split(p_name, ' ')) AS canonical FROM part""")
def parse_dictionary(spark, sf_dir):
    names = F.create_map("p_brand", F.split("p_name", " "))
    told = table(spark, sf_dir, "part").select("p_partkey", _envelope(F.to_json(names)).alias("reply"))
    return replies.parse_dictionary(told, strict=True)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def parse_properties(spark, sf_dir):
    told = table(spark, sf_dir, "events").select("event_id", _envelope(F.col("props")).alias("reply"))
    schema = S.T.StructType([S.T.StructField("k", S.T.StringType())])
    return told.select("event_id", replies.parse_reply(F.col("reply"), schema)["k"].alias("k"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 AND role <> 'assistant' THEN 'later' ELSE text END AS reply FROM conversations")
def normalize_reply(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    message = lambda role, text: F.struct(F.lit(None).cast("string").alias("type"), role.alias("role"), text.alias("content"))
    listed = F.array(
        message(F.lit("user"), F.lit("hello")), message(F.col("role"), F.col("text")), message(F.lit("user"), F.lit("later"))
    )
    alone = F.array(message(F.lit("user"), F.lit("hello")), message(F.lit("user"), F.col("text")))
    shape = F.col("turn") % 4
    reply = (
        F.when(shape == 0, F.col("text"))
        .when(shape == 1, F.to_json(F.struct(F.col("text").alias("content"))))
        .when(shape == 2, F.to_json(F.struct(alone.alias("messages"))))
        .otherwise(F.to_json(F.struct(listed.alias("messages"))))
    )
    return turns.select("conv_id", "turn", replies.normalize_reply(reply).alias("reply"))


@query("""
SELECT conv_id, turn, role, text AS content FROM conversations
UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'and now?' FROM conversations
GROUP BY conv_id HAVING count_if(role = 'user') > 0""")
def conversation_history(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id").distinct().withColumn("text", F.lit("and now?"))
    return conversations.conversation_history(turns, asked)


@query("""
SELECT conv_id, coalesce(max_by(text, turn) FILTER (WHERE role = 'assistant'), max_by(text, turn)) AS reply
FROM conversations GROUP BY conv_id""")
def last_reply(spark, sf_dir):
    return conversations.last_reply(table(spark, sf_dir, "conversations"))
