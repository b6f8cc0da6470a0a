"""Reading the JSON replies of a text service with built-in JSON functions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt import schemas as S

_MESSAGES = "array<struct<type:string,role:string,content:string>>"


def last_block_text(reply: Column) -> Column:
    """Text of the last content block of a reply envelope; null if it cannot be read."""
    blocks = F.from_json(reply, S.REPLY_BLOCKS)
    return F.try_element_at(blocks, F.lit(-1)).getField("text")


def parse_reply(reply: Column, schema: T.StructType = S.EXTRACTED) -> Column:
    """Reply envelope -> extraction struct; unreadable replies give null fields."""
    return F.from_json(last_block_text(reply), schema)


def parse_dictionary(df: DataFrame, reply: str = "reply", strict: bool = False) -> DataFrame:
    """Reply envelopes holding ``{manufacturer: [names]}`` -> (other columns, manufacturer, pos, canonical).

    ``strict`` fails the job on a reply that is not such a map; otherwise it gives no rows.
    """
    names = F.from_json(last_block_text(F.col(reply)), "map<string,array<string>>")
    if strict:
        bad = F.concat(F.lit("not a model dictionary: "), F.coalesce(F.col(reply), F.lit("null")))
        names = F.when(names.isNull(), F.raise_error(bad).cast("map<string,array<string>>")).otherwise(names)
    kept = [c for c in df.columns if c != reply]
    per_maker = df.select(*kept, F.explode(names).alias("manufacturer", "names"))
    return per_maker.select(*kept, "manufacturer", F.posexplode("names").alias("pos", "canonical"))


def normalize_reply(reply: Column) -> Column:
    """One text out of the reply shapes a chat service returns.

    A ``messages`` list gives its last assistant message, else its last message with
    content; an object with ``content`` gives that; anything else is returned as it is.
    """
    messages = F.from_json(F.get_json_object(reply, "$.messages"), _MESSAGES)
    with_content = F.filter(messages, lambda m: m["content"].isNotNull())
    by_assistant = F.filter(with_content, lambda m: (m["type"] == "ai") | (m["role"] == "assistant"))
    return F.coalesce(
        F.try_element_at(by_assistant, F.lit(-1)).getField("content"),
        F.try_element_at(with_content, F.lit(-1)).getField("content"),
        F.get_json_object(reply, "$.content"),
        reply,
    )
