"""Per-message facts and per-conversation features.

``message_facts`` reads the text once and leaves about a hundred bytes per message: lengths, flags and
hashes. Statistics, quality and profile are all built on it, so no text is ever shuffled for them, and
a caller that needs several of them can write the facts once and reuse them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import conversation as C
from parley.functions import text as T
from parley.schema import CONV_KEY, MIN_MESSAGES, PREFIX_CHARS, ROLES

# Hash lanes of a message; 15 hex digits each, so a lane fits a non-negative BIGINT.
_LANES = ("lane_a", "lane_b", "lane_c")
_CONTENT_LANES = ("content_a", "content_b", "content_c")


def _lanes(digest: Column, names: tuple[str, ...]) -> list[Column]:
    return [
        F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint").alias(name)
        for i, name in enumerate(names)
    ]


def message_facts(messages: DataFrame) -> DataFrame:
    """One narrow row per message. No shuffle; unused columns are pruned away by the optimizer."""
    text, role = F.col("text"), F.col("role")
    # NULL unless an answer; all that follows is NULL with it, and shared parts are computed once.
    answer = F.when(role == "assistant", text)
    normal = T.normalised(answer)
    prefix = F.sha2(F.concat_ws(":", F.col("turn"), role, F.substring(text, 1, PREFIX_CHARS)), 256)
    # The whole text, with NULL told from empty.
    content = F.sha2(F.concat_ws(":", F.col("turn"), role, F.length(text), text), 256)
    return messages.select(
        *CONV_KEY,
        "turn",
        "role",
        F.length(text).cast("bigint").alias("n_chars"),
        (role.isNull() | ~role.isin(*ROLES) | text.isNull() | T.is_blank(text)).alias("is_bad"),
        answer.isNotNull().alias("is_answer"),
        F.length(T.strip(answer)).alias("response_chars"),
        T.content_hash(normal).alias("response_hash"),
        T.has_non_ascii(normal).alias("non_ascii"),
        T.looks_like_json(answer).alias("json_like"),
        *_lanes(prefix, _LANES),
        *_lanes(content, _CONTENT_LANES),
    )


def conversation_features(facts: DataFrame, *more: Column) -> DataFrame:
    """One row per conversation from :func:`message_facts`; ``more`` are further aggregates of it.

    A single hash aggregate over fixed-width buffers with map-side combining. A fingerprint is the
    XOR of position-tagged message hashes with the message count: it needs neither an ordered list nor
    the text, and equal conversations get equal fingerprints however their rows are spread.
    ``fingerprint`` looks at the first 100 characters of each message and is for counting alone;
    ``content_fingerprint`` looks at whole messages and says which conversations are the same.
    """
    role = F.col("role")
    chars = F.col("n_chars")
    response = F.col("response_chars")
    band = C.response_band(response)
    zero = F.lit(0).cast("bigint")

    def chars_of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(role == name, chars)), zero)

    def responses(name: str) -> Column:
        return F.count_if(response.isNotNull() & (band == name))

    counted = facts.groupBy(*CONV_KEY).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(role == "user").alias("n_user"),
        F.count_if(role == "assistant").alias("n_assistant"),
        F.count_if(role == "system").alias("n_system"),
        F.coalesce(F.sum(chars), zero).alias("n_chars"),
        chars_of("user").alias("user_chars"),
        chars_of("assistant").alias("assistant_chars"),
        responses("blank").alias("blank_responses"),
        responses("short").alias("short_responses"),
        responses("very_long").alias("long_responses"),
        F.count_if("is_bad").alias("n_bad"),
        *[F.bit_xor(lane).alias(lane) for lane in (*_LANES, *_CONTENT_LANES)],
        *more,
    )
    return _with_derived(counted).select(
        "*",
        F.concat_ws(":", "n_messages", *_LANES).alias("fingerprint"),
        F.concat_ws(":", "n_messages", *_CONTENT_LANES).alias("content_fingerprint"),
        (
            (F.col("n_bad") == 0)
            & (F.col("n_messages") >= MIN_MESSAGES)
            & (F.col("n_user") > 0)
            & (F.col("n_assistant") > 0)
        ).alias("is_valid"),
    ).drop(*_LANES, *_CONTENT_LANES)


def chat_features(chats: DataFrame) -> DataFrame:
    """The same features from the nested shape, as a projection without any shuffle.

    Here the fingerprints hash literal joined texts.
    """
    messages = F.col("messages")
    # Parts used several times are projected first, so they are computed once.
    parts = chats.select(
        *CONV_KEY,
        "messages",
        C.of_role(messages, "user").alias("user"),
        C.of_role(messages, "assistant").alias("assistant"),
    ).withColumn("bands", C.response_bands(F.col("assistant")))

    def size(array: Column) -> Column:
        return F.size(array).cast("bigint")

    def responses(band: str) -> Column:
        return size(F.filter("bands", lambda b: b == band))

    counted = parts.select(
        *CONV_KEY,
        size(messages).alias("n_messages"),
        size(F.col("user")).alias("n_user"),
        size(F.col("assistant")).alias("n_assistant"),
        size(C.of_role(messages, "system")).alias("n_system"),
        C.total_chars(messages).alias("n_chars"),
        C.total_chars(F.col("user")).alias("user_chars"),
        C.total_chars(F.col("assistant")).alias("assistant_chars"),
        responses("blank").alias("blank_responses"),
        responses("short").alias("short_responses"),
        responses("very_long").alias("long_responses"),
        C.fingerprint(messages).alias("fingerprint"),
        C.content_fingerprint(messages).alias("content_fingerprint"),
    )
    return _with_derived(counted)


def _with_derived(counted: DataFrame) -> DataFrame:
    n_user, n_assistant = F.col("n_user"), F.col("n_assistant")
    return counted.select(
        "*",
        C.estimated_tokens(F.col("n_chars")).alias("n_tokens"),
        C.is_single_turn(n_user, n_assistant).alias("is_single_turn"),
        C.is_two_message(F.col("n_messages"), F.col("n_system")).alias("is_two_message"),
        (F.col("n_system") > 0).alias("has_system"),
    )


def valid_only(features: DataFrame) -> DataFrame:
    return features.where("is_valid")


def facts_of_valid(facts: DataFrame) -> DataFrame:
    """Facts of valid conversations. Only narrow rows take part in the join."""
    valid = valid_only(conversation_features(facts)).select(*CONV_KEY)
    return facts.join(valid, CONV_KEY, "left_semi")


def role_counts(messages: DataFrame) -> DataFrame:
    """Messages per role and dataset. Messages of any other role are not counted."""
    return (
        messages.groupBy("dataset_id")
        .pivot("role", list(ROLES))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "dataset_id",
            *[F.coalesce(F.col(r), F.lit(0)).cast("bigint").alias(f"{r}_messages") for r in ROLES],
        )
        .withColumn(
            "total_messages",
            F.col("system_messages") + F.col("user_messages") + F.col("assistant_messages"),
        )
    )


def token_budget(features: DataFrame, budget: int) -> DataFrame:
    """Per dataset: conversations whose estimated tokens exceed ``budget``."""
    over = F.col("n_tokens") > budget
    return features.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_examples"),
        F.count_if(over).alias("over_budget"),
        F.max("n_tokens").alias("max_tokens"),
        F.coalesce(F.sum(F.when(over, F.col("n_tokens") - budget)), F.lit(0)).alias("excess_tokens"),
    )
