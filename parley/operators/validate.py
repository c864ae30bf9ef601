"""Validation of message tables, first errors and the dataset gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.first import first_rows
from parley.schema import CONV_KEY, ERRORS_SHOWN, MIN_EXAMPLES, MIN_MESSAGES, ROLES
from parley.session import written_once

# Messages of the rules a columnar message can break, after the position prefix.
_MESSAGE_RULES = {
    "role": "invalid role '%s'. Must be: system, user, or assistant",
    "content_type": "'content' must be a string",
    "content_empty": "'content' cannot be empty",
}
# Messages of the rules a conversation can break.
_CONVERSATION_RULES = {
    "too_few_messages": "need at least 2 messages (user + assistant)",
    "no_user": "conversation must have at least one 'user' message",
    "no_assistant": "conversation must have at least one 'assistant' message",
}
NO_EXAMPLES = "File is empty or contains no valid examples."
TOO_FEW_EXAMPLES = "Need at least 50 examples for fine-tuning. Found only %d."


def _message_error(role: Column, text: Column) -> Column:
    return (
        F.when(role.isNull() | ~role.isin(*ROLES), "role")
        .when(text.isNull(), "content_type")
        .when(T.is_blank(text), "content_empty")
    )


def validate_messages(messages: DataFrame) -> DataFrame:
    """``error_code, msg_idx, message`` per conversation; NULL where it is valid.

    The first broken rule names the error: too few messages, then the messages from left to right,
    then a missing user or assistant. Texts name the conversation id as the line and the message by its
    place. One hash aggregate over numbers and flags judges all conversations; it is written, so that Spark
    knows how few are broken, and only for those the messages are looked at again, for the role and
    the place of the first broken one.
    """
    role, turn = F.col("role"), F.col("turn")
    marked = messages.select(*CONV_KEY, "turn", "role", _message_error(role, F.col("text")).alias("error"))
    counts = marked.groupBy(*CONV_KEY).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.bool_or(F.coalesce(role == "user", F.lit(False))).alias("has_user"),
        F.bool_or(F.coalesce(role == "assistant", F.lit(False))).alias("has_assistant"),
        F.min(F.when(F.col("error").isNotNull(), turn)).alias("bad_turn"),
    )
    counts = written_once(counts, "message-counts")
    broken = written_once(counts.where("bad_turn is not null").select(*CONV_KEY, "bad_turn"), "broken")
    details = (
        marked.join(broken, CONV_KEY)
        .where("turn <= bad_turn")
        .groupBy(*CONV_KEY)
        .agg(
            F.count_if(turn < F.col("bad_turn")).alias("before"),
            F.min(F.when(turn == F.col("bad_turn"), F.struct("error", "role"))).alias("bad"),
        )
    )
    judged = counts.join(details, CONV_KEY, "left")
    code = (
        F.when(F.col("n_messages") < MIN_MESSAGES, "too_few_messages")
        .when(F.col("bad").isNotNull(), F.col("bad.error"))
        .when(~F.col("has_user"), "no_user")
        .when(~F.col("has_assistant"), "no_assistant")
    )
    judged = judged.withColumn("error_code", code).withColumn(
        "place", (F.coalesce("before", F.lit(0)) + 1).cast("bigint")
    )
    in_message = F.col("error_code").isin(*_MESSAGE_RULES)
    # Turns may start anywhere and have gaps: a message's number is its place in the conversation.
    index = F.when(in_message, F.col("place"))
    line = F.col("conv_id")
    per_message = F.col("error_code")
    bodies = F.create_map(
        *[F.lit(x) for item in {**_MESSAGE_RULES, **_CONVERSATION_RULES}.items() for x in item]
    )
    body = F.when(
        per_message == "role",
        F.format_string(_MESSAGE_RULES["role"], F.coalesce(F.col("bad.role"), F.lit("None"))),
    ).otherwise(bodies[per_message])
    message = F.when(
        in_message, F.concat(F.format_string("Line %d, message %d: ", line, index), body)
    ).otherwise(F.concat(F.format_string("Line %d: ", line), body))
    return judged.select(
        *CONV_KEY, "n_messages", "error_code", index.alias("msg_idx"), message.alias("message")
    )


def first_errors(errors: DataFrame, order: str = "conv_id", shown: int = ERRORS_SHOWN) -> DataFrame:
    """The first errors of each dataset in order, numbered from 1."""
    failed = errors.where(F.col("error_code").isNotNull()).select(
        "dataset_id", order, "error_code", "message"
    )
    return first_rows(failed, ["dataset_id"], [order], shown, "error_no").withColumn(
        "error_no", F.col("error_no").cast("bigint")
    )


def error_summary(errors: DataFrame, order: str = "conv_id", shown: int = ERRORS_SHOWN) -> DataFrame:
    """The first errors of each dataset as one text; at most ``shown`` short lines per dataset."""
    lines = F.array_sort(F.collect_list(F.struct("error_no", "message")))
    return (
        first_errors(errors, order, shown)
        .groupBy("dataset_id")
        .agg(
            F.concat(
                F.lit("Validation failed:\n"),
                F.array_join(F.transform(lines, lambda e: e["message"]), "\n"),
            ).alias("error_msg")
        )
    )


def dataset_gate(verdicts: DataFrame, order: str = "conv_id", strict: bool = True) -> DataFrame:
    """Accept or reject each dataset.

    ``verdicts`` has one row per conversation or line with ``dataset_id, error_code, message``.
    Strict mode rejects a dataset for any error; otherwise bad rows are set aside and only the number
    of valid ones counts. The verdicts, without any text, are written once for both their uses.
    """
    verdicts = verdicts.select("dataset_id", order, "error_code", "message")
    if strict:
        verdicts = written_once(verdicts, "verdicts")
    counts = verdicts.groupBy("dataset_id").agg(
        F.count_if(F.col("error_code").isNull()).alias("n_valid"),
        F.count_if(F.col("error_code").isNotNull()).alias("n_errors"),
    )
    return gate_of(counts, error_summary(verdicts, order) if strict else None)


def gate_of(counts: DataFrame, summary: DataFrame | None) -> DataFrame:
    """The verdict from ``n_valid, n_errors`` of each dataset; with ``summary`` any error there rejects it."""
    n = F.col("n_valid")
    if summary is not None:
        counts = counts.join(summary, "dataset_id", "left")
    else:
        counts = counts.withColumn("error_msg", F.lit(None).cast("string"))
    reason = F.coalesce(
        F.col("error_msg"),
        F.when(n == 0, NO_EXAMPLES).when(n < MIN_EXAMPLES, F.format_string(TOO_FEW_EXAMPLES, n)),
    )
    return counts.select(
        "dataset_id", "n_valid", "n_errors", reason.isNull().alias("accepted"), reason.alias("error_msg")
    )


def accepted_rows(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of accepted datasets.

    The gate has one row per dataset. Written first, it is broadcast if small and the rows stay where
    they are; else adaptive execution splits the hot datasets of a sort-merge join.
    """
    accepted = written_once(gate.where("accepted").select("dataset_id"), "accepted")
    return rows.join(accepted, "dataset_id", "left_semi")


def rejected_datasets(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """Ids of datasets in ``rows`` that the gate did not accept."""
    return rows.select("dataset_id").distinct().join(
        gate.where("accepted").select("dataset_id"), "dataset_id", "left_anti"
    )
