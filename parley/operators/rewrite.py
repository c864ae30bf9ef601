"""Rewrites of a chat table: add system prompts, keep whole conversations by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import conversation as C
from parley.schema import CONV_KEY


def _checked_prompt(prompt: str) -> str:
    prompt = prompt.strip()
    if not prompt:
        raise ValueError("System prompt cannot be empty")
    return prompt


def add_system_prompt(chats: DataFrame, prompt: str) -> DataFrame:
    """Prepend a system message to every conversation that has none. No shuffle.

    Adds ``modified``. A ``raw`` variant, if there, is rewritten too: extra keys survive at both
    levels, key order and number spelling may change (``1.50`` becomes ``1.5``).
    """
    prompt = _checked_prompt(prompt)
    messages = F.col("messages")
    missing = ~C.has_role(messages, "system")
    columns = {"messages": C.prepend_system(messages, prompt), "modified": missing}
    if "raw" in chats.columns:
        first = F.to_variant_object(
            F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content"))
        )
        old = F.variant_get("raw", "$.messages", "array<variant>")
        fields = F.map_filter(F.col("raw").cast("map<string,variant>"), lambda k, _: k != "messages")
        new = F.map_concat(
            fields,
            F.create_map(F.lit("messages"), F.to_variant_object(F.concat(F.array(first), old))),
        )
        columns["raw"] = F.when(missing, F.to_variant_object(new)).otherwise(F.col("raw"))
    return chats.withColumns(columns)


def modified_counts(rewritten: DataFrame) -> DataFrame:
    """Conversations changed per dataset."""
    return rewritten.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_examples"), F.count_if("modified").alias("modified_count")
    )


def add_system_prompt_rows(messages: DataFrame, prompt: str) -> DataFrame:
    """The same on ``messages``: a new row at turn 0, the later turns moved by one.

    One pass and one shuffle by conversation: the first row of a conversation without a system message
    brings the new row with it.
    """
    prompt = _checked_prompt(prompt)
    conversation = Window.partitionBy(*CONV_KEY)
    is_system = F.coalesce(F.col("role") == "system", F.lit(False))
    marked = messages.select(*CONV_KEY, "turn", "role", "text").withColumns(
        {
            "_lacks": ~F.max(is_system).over(conversation),
            "_place": F.row_number().over(conversation.orderBy("turn")),
        }
    )
    turn = F.col("turn") + F.col("_lacks").cast("int")
    own = F.struct(turn.cast("bigint").alias("turn"), "role", "text")
    new = F.struct(
        F.lit(0).cast("bigint").alias("turn"), F.lit("system").alias("role"), F.lit(prompt).alias("text")
    )
    rows = F.when(F.col("_lacks") & (F.col("_place") == 1), F.array(new, own)).otherwise(F.array(own))
    return marked.select(*CONV_KEY, F.inline(rows))


def keep_conversations(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the conversations listed in ``keys``."""
    return rows.join(keys.select(*CONV_KEY), CONV_KEY, "left_semi")
