"""Data steps around training: rendered text, prompt/answer pairs, samples, containment scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import conversation as C
from parley.functions import text as T
from parley.operators.first import first_rows, rows_at_quarters
from parley.schema import CONV_KEY, PREVIEW_ROWS, SAMPLE_ROWS
from parley.session import written_once

# A plain template; pass the one of your tokenizer.
CHAT_TEMPLATE = {
    "system": ("<|system|>\n", "\n"),
    "user": ("<|user|>\n", "\n"),
    "assistant": ("<|assistant|>\n", "\n"),
}


def render_chats(chats: DataFrame, template: dict[str, tuple[str, str]] = CHAT_TEMPLATE) -> DataFrame:
    """One training text per conversation, without a generation prompt. No shuffle."""
    return chats.select(*CONV_KEY, C.render(F.col("messages"), template).alias("text"))


def prompt_pairs(chats: DataFrame) -> DataFrame:
    """``prompt`` and ``expected`` per conversation from the nested shape. No shuffle."""
    pair = C.prompt_and_expected(F.col("messages"))
    return (
        chats.select(*CONV_KEY, pair.alias("pair"))
        .select(*CONV_KEY, "pair.*")
        .where(F.col("prompt") != "")
    )


def prompt_pairs_of_messages(messages: DataFrame) -> DataFrame:
    """``prompt`` and ``expected`` per conversation from ``messages``.

    A running window carries the latest user text to each answer; the aggregate that picks the first
    answer reuses the window's partitioning and order, so there is one shuffle.
    """
    role, text = F.col("role"), F.col("text")
    so_far = Window.partitionBy(*CONV_KEY).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    marked = messages.where(role.isin("user", "assistant")).withColumn(
        "asked", F.last(F.when(role == "user", text), ignorenulls=True).over(so_far)
    )
    answered = (role == "assistant") & (F.col("asked") != "")
    pair = F.min_by(F.when(answered, F.struct("asked", "text")), F.when(answered, F.col("turn")))
    last_user = F.max_by(F.when(role == "user", text), F.when(role == "user", F.col("turn")))
    return (
        marked.groupBy(*CONV_KEY)
        .agg(pair.alias("pair"), last_user.alias("last_user"))
        .select(
            *CONV_KEY,
            F.coalesce("pair.asked", "last_user").alias("prompt"),
            F.col("pair.text").alias("expected"),
        )
        .where(F.col("prompt") != "")
    )


def with_snippets(pairs: DataFrame) -> DataFrame:
    """Short display forms of a pair: 100 characters of the prompt, 50 of the answer."""
    return pairs.select(
        *CONV_KEY,
        T.snippet(F.col("prompt"), 100).alias("prompt_snippet"),
        T.snippet(F.col("expected"), 50).alias("expected_snippet"),
    )


def context_before_answer(messages: DataFrame) -> DataFrame:
    """The messages before each conversation's first assistant message.

    The bound is a map-side-combined minimum over two narrow columns; conversations without an
    assistant keep all their messages.
    """
    bound = (
        messages.where(F.col("role") == "assistant")
        .groupBy(*CONV_KEY)
        .agg(F.min("turn").alias("_bound"))
    )
    # An answer never precedes the first one, so answers stay out of the join.
    return (
        messages.where(~F.col("role").eqNullSafe("assistant"))
        .join(bound, CONV_KEY, "left")
        .where(F.col("_bound").isNull() | (F.col("turn") < F.col("_bound")))
        .drop("_bound")
    )


def positional_sample(conversations: DataFrame) -> DataFrame:
    """The conversations at the start, the quarters and the end of each dataset."""
    return rows_at_quarters(conversations, "dataset_id", "conv_id")


def sample_page(conversations: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """Keys of the first ``limit`` conversations of each dataset, numbered from 1."""
    page = first_rows(conversations.select(*CONV_KEY), ["dataset_id"], ["conv_id"], limit, "row_no")
    return page.withColumn("row_no", F.col("row_no").cast("bigint"))


def preview(rows: DataFrame, conversations: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """All rows of the first ``n`` conversations of each dataset.

    The page's keys are written first: when they are few the rows are filtered where they are read.
    """
    return rows.join(written_once(sample_page(conversations, n), "page"), CONV_KEY)


def page_totals(conversations: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """Rows in each dataset and rows a page of ``limit`` returns."""
    if limit < 0:
        raise ValueError("the number of rows must not be negative")
    return (
        conversations.groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("total_rows"))
        .withColumn("returned_rows", F.least(F.lit(limit), F.col("total_rows")))
    )


def containment_accuracy(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Share of pairs whose stripped, lower-cased answer occurs in the lower-cased response.

    Pairs without an answer or without a response count as not matched.
    """
    match = F.contains(F.lower("response"), T.normalised(F.col("expected")))
    return (
        pairs.join(predictions.select(*CONV_KEY, "response"), CONV_KEY, "left")
        .select("dataset_id", (F.coalesce(match, F.lit(False)) & (F.col("expected") != "")).alias("match"))
        .groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("match").alias("correct"))
        .withColumn(
            "accuracy_pct",
            T.round_one_decimal(F.lit(100.0) * F.col("correct") / F.col("total")),
        )
    )


def first_system_prompt(messages: DataFrame) -> DataFrame:
    """The system prompt that opens each dataset's first conversation, or NULL.

    A minimum finds the first conversation; only its rows go on, and only one message per dataset
    is compared by turn.
    """
    first = written_once(messages.groupBy("dataset_id").agg(F.min("conv_id").alias("conv_id")), "first")
    opening = (
        messages.join(first, CONV_KEY, "left_semi")
        .groupBy("dataset_id")
        .agg(F.min("turn").alias("turn"))
        .join(first, "dataset_id")
    )
    system = messages.where(F.col("role") == "system").join(opening, [*CONV_KEY, "turn"])
    return first.select("dataset_id").join(
        system.select("dataset_id", F.col("text").alias("system_prompt")), "dataset_id", "left"
    )
