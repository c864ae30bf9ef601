"""Move between the two shapes of a chat table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.schema import CONV_KEY


def explode_messages(chats: DataFrame) -> DataFrame:
    """``chats`` to ``messages``: one row per message. No shuffle."""
    return chats.select(*CONV_KEY, F.posexplode("messages").alias("turn", "m")).select(
        *CONV_KEY,
        F.col("turn").cast("bigint").alias("turn"),
        F.col("m.role").alias("role"),
        F.col("m.content").alias("text"),
    )


def nest_messages(messages: DataFrame) -> DataFrame:
    """``messages`` to ``chats``, ordered by turn.

    This shuffles the text once, so it is used only where the result row holds the whole conversation
    (a JSONL line, a rendered example). Statistics go through
    :func:`parley.operators.features.conversation_features`, which shuffles numbers only.
    """
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return messages.groupBy(*CONV_KEY).agg(
        F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias(
            "messages"
        )
    )
