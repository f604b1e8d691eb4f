"""Chat histories as ordered rows, and the messages sent for the next turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def request_order(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """``df`` with ``pos`` (system messages first, then turns in order) and ``with_image``: the first user turn."""
    own = Window.partitionBy(conv)
    system_last = F.when(F.col(role) == "system", 0).otherwise(1)
    first_user = F.min(F.when(F.col(role) == "user", F.col(turn))).over(own)
    return df.withColumn("pos", F.row_number().over(own.orderBy(system_last, turn)) - 1).withColumn(
        "with_image", F.coalesce((F.col(role) == "user") & (F.col(turn) == first_user), F.lit(False))
    )


def history(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its messages as an array of (role, text) in request order."""
    placed = request_order(df, conv, turn, role)
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col(role).alias("role"), F.col(text).alias("text"))))
    return placed.groupBy(conv).agg(F.transform(rows, lambda m: F.struct(m["role"], m["text"])).alias("messages"))


def answered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, question, answer)``: each user turn with the assistant's turn right after it."""
    own = Window.partitionBy(conv).orderBy(turn)
    after = df.select(conv, turn, role, F.col(text).alias("question"), F.lead(role).over(own).alias("_r"), F.lead(text).over(own).alias("answer"))
    return after.filter((F.col(role) == "user") & (F.col("_r") == "assistant")).select(conv, turn, "question", "answer")
