"""Dataset profile and the characteristics the recommendation uses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.features import conversation_features, valid_only
from parley.operators.first import first_rows
from parley.schema import (
    CLASSIFICATION_MAX_DISTINCT,
    CONV_KEY,
    JSON_SHARE,
    MULTILINGUAL_SHARE,
)
from parley.session import written_once


def structure_profile(features: DataFrame) -> DataFrame:
    """Counts, averages and structure of each dataset."""
    n = F.col("num_examples")
    sums = features.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("num_examples"),
        F.sum(F.col("n_user") + F.col("n_assistant") + F.col("n_system")).alias("total_messages"),
        F.sum("n_messages").alias("_messages"),
        F.sum("n_user").alias("user_messages"),
        F.sum("n_assistant").alias("assistant_messages"),
        F.sum("n_system").alias("system_messages"),
        F.sum("assistant_chars").alias("_assistant_chars"),
        F.sum("n_chars").alias("_chars"),
        F.count_if("is_two_message").alias("single_turn"),
        F.count_if(~F.col("is_two_message")).alias("multi_turn"),
        F.count_if("has_system").alias("with_system"),
    )
    per_conversation = T.safe_ratio(F.col("_messages"), n)
    per_response = T.safe_ratio(F.col("_assistant_chars"), F.col("assistant_messages"))
    return sums.select(
        "dataset_id",
        "num_examples",
        "total_messages",
        T.round_one_decimal(per_conversation).alias("avg_messages_per_example"),
        "user_messages",
        "assistant_messages",
        "system_messages",
        F.coalesce(T.round_half_even(per_response), F.lit(0)).alias("avg_response_length"),
        T.round_half_even(per_conversation).alias("avg_conversation_length"),
        "single_turn",
        "multi_turn",
        "with_system",
        (n - F.col("with_system")).alias("without_system"),
        T.floor_div(F.col("_chars"), 4).alias("estimated_tokens"),
        (F.col("with_system") > 0).alias("has_system_prompts"),
        (F.col("multi_turn") > F.col("single_turn")).alias("is_multi_turn"),
    )


def _distinct_responses(facts: DataFrame) -> DataFrame:
    return facts.where("is_answer").groupBy("dataset_id", "response_hash")


def response_profile(facts: DataFrame, sample: int | None = None) -> DataFrame:
    """Distinct answers per dataset and what they look like.

    Distinctness is decided on a hash, grouped by (dataset, hash) with map-side combining. The
    multilingual share is taken over all distinct answers, or over the first ``sample`` of them by
    first appearance.
    """
    if sample is None:
        distinct = _distinct_responses(facts).agg(F.bool_or("non_ascii").alias("non_ascii"))
    else:
        # Two fixed-width minima find the first appearance: the conversation, then the turn in it.
        first = _distinct_responses(facts).agg(F.min("conv_id").alias("conv_id"))
        distinct = (
            facts.select("dataset_id", "response_hash", "conv_id", "turn", "non_ascii")
            .join(first, ["dataset_id", "response_hash", "conv_id"])
            .groupBy("dataset_id", "response_hash", "conv_id")
            .agg(F.min("turn").alias("turn"), F.bool_or("non_ascii").alias("non_ascii"))
        )
        head = first_rows(distinct, ["dataset_id"], ["conv_id", "turn"], sample)
        counted = distinct.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("distinct_responses"))
        shares = head.groupBy("dataset_id").agg(
            F.count(F.lit(1)).alias("_sampled"), F.count_if("non_ascii").alias("non_ascii_responses")
        )
        return _response_flags(counted.join(shares, "dataset_id"))
    return _response_flags(
        distinct.groupBy("dataset_id").agg(
            F.count(F.lit(1)).alias("distinct_responses"),
            F.count(F.lit(1)).alias("_sampled"),
            F.count_if("non_ascii").alias("non_ascii_responses"),
        )
    )


def _response_flags(counts: DataFrame) -> DataFrame:
    n = F.col("distinct_responses")
    return counts.select(
        "dataset_id",
        "distinct_responses",
        "non_ascii_responses",
        ((n > 0) & (n < CLASSIFICATION_MAX_DISTINCT)).alias("looks_like_classification"),
        (
            T.safe_ratio(F.col("non_ascii_responses"), F.col("_sampled")) > MULTILINGUAL_SHARE
        ).alias("is_multilingual"),
    )


def json_profile(facts: DataFrame, sample: int | None = None) -> DataFrame:
    """JSON-like share of all non-blank answers, or of the first ``sample`` in file order."""
    answers = facts.where(F.col("is_answer") & ~F.col("is_bad")).select(
        "dataset_id", "conv_id", "turn", "json_like"
    )
    head = answers if sample is None else first_rows(answers, ["dataset_id"], ["conv_id", "turn"], sample)
    return head.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("sampled_responses"),
        F.count_if("json_like").alias("json_responses"),
        (F.count_if("json_like").cast("double") / F.count(F.lit(1)).cast("double") > JSON_SHARE).alias(
            "looks_like_json_output"
        ),
    )


def answered_conversations(facts: DataFrame) -> DataFrame:
    """Features of the valid conversations, each with the facts of its answers as an array.

    One aggregation by conversation, so the facts are shuffled by it once for all that follows. The
    array is bounded as a conversation is.
    """
    answer = F.when(
        F.col("is_answer"), F.struct("turn", "response_hash", "non_ascii", "json_like", "is_bad")
    )
    return valid_only(conversation_features(facts, F.collect_list(answer).alias("answers")))


def dataset_profile(facts: DataFrame, sample: int | None = None, reuse: bool = True) -> DataFrame:
    """Profile and characteristics of the valid conversations, one row per dataset.

    Three aggregates over :func:`answered_conversations` are joined at one row per dataset. With
    ``reuse`` those are written to the shared folder first, so the text is read and hashed once and
    the facts are shuffled once.
    """
    conversations = answered_conversations(facts)
    if reuse:
        conversations = written_once(conversations, "answered")
    answers = conversations.select(*CONV_KEY, F.inline("answers")).withColumn("is_answer", F.lit(True))
    joined = (
        structure_profile(conversations)
        .join(response_profile(answers, sample), "dataset_id", "left")
        .join(json_profile(answers, sample), "dataset_id", "left")
    )
    return (
        joined.fillna(0, ["distinct_responses", "non_ascii_responses"])
        .fillna(False, ["looks_like_classification", "is_multilingual", "looks_like_json_output"])
        .drop("sampled_responses", "json_responses")
    )
