"""Chat turns as a table (conv_id, turn, role, text)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def conversation_history(turns: DataFrame, new_turns: DataFrame | None = None) -> DataFrame:
    """Messages of every conversation in order, one row each: (conv_id, turn, role, content).

    ``new_turns`` (conv_id, text) are user messages that follow the last turn, several of one
    conversation in the order of their texts. Rows stay
    rows: a conversation of any length is sorted by range, never gathered into one cell.
    """
    history = turns.select("conv_id", "turn", "role", F.col("text").alias("content"))
    if new_turns is not None:
        last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
        nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("text"))
        asked = new_turns.withColumn("nth", nth).join(last, "conv_id", "left").select(
            "conv_id",
            (F.coalesce("last", F.lit(-1).cast("long")) + F.col("nth")).alias("turn"),
            F.lit("user").alias("role"),
            F.col("text").alias("content"),
        )
        history = history.unionByName(asked)
    return history.orderBy("conv_id", "turn")


def last_reply(turns: DataFrame) -> DataFrame:
    """Last assistant message of every conversation, or its last message if there is none."""
    by_assistant = F.when((F.col("role") == "assistant") & F.col("text").isNotNull(), F.col("turn"))
    with_text = F.when(F.col("text").isNotNull(), F.col("turn"))
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max_by("text", by_assistant), F.max_by("text", with_text)).alias("reply")
    )
