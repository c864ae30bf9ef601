"""Features of one conversation held as ``messages ARRAY<STRUCT<role, content>>``.

All functions take the array column and return a column; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.schema import LONG_RESPONSE, PREFIX_CHARS, SHORT_RESPONSE


def of_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def total_chars(messages: Column) -> Column:
    return F.aggregate(
        messages, F.lit(0).cast("bigint"), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0))
    )


def estimated_tokens(chars: Column) -> Column:
    """About four characters per token."""
    return T.floor_div(chars, 4)


def is_single_turn(n_user: Column, n_assistant: Column) -> Column:
    """Exactly one user and one assistant message."""
    return (n_user == 1) & (n_assistant == 1)


def is_two_message(n_messages: Column, n_system: Column) -> Column:
    """Exactly two messages that are not system messages."""
    return (n_messages - n_system) == 2


def has_role(messages: Column, role: str) -> Column:
    return F.exists(messages, lambda m: m["role"] == role)


def fingerprint_text(messages: Column) -> Column:
    """``role:first 100 characters`` of every message, in order, joined by ``|``."""
    return F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(
                F.coalesce(m["role"], F.lit("")),
                F.lit(":"),
                F.coalesce(F.substring(m["content"], 1, PREFIX_CHARS), F.lit("")),
            ),
        ),
        "|",
    )


def fingerprint(messages: Column) -> Column:
    return F.sha2(fingerprint_text(messages), 256)


def content_fingerprint(messages: Column) -> Column:
    """A hash of every message in full: ``role:length:content`` joined by ``|``, no length for NULL."""
    whole = F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(
                F.coalesce(m["role"], F.lit("")),
                F.lit(":"),
                F.coalesce(F.length(m["content"]).cast("string"), F.lit("")),
                F.lit(":"),
                F.coalesce(m["content"], F.lit("")),
            ),
        ),
        "|",
    )
    return F.sha2(whole, 256)


def response_band(stripped_chars: Column) -> Column:
    """``blank`` / ``short`` / ``normal`` / ``very_long`` by stripped length."""
    return (
        F.when(stripped_chars == 0, "blank")
        .when(stripped_chars < SHORT_RESPONSE, "short")
        .when(stripped_chars > LONG_RESPONSE, "very_long")
        .otherwise("normal")
    )


def response_bands(answers: Column) -> Column:
    """The band of every assistant message."""
    lengths = F.transform(answers, lambda m: F.length(T.strip(m["content"])))
    return F.transform(lengths, response_band)


def prepend_system(messages: Column, prompt: str) -> Column:
    """Put a system message first unless the conversation already has one anywhere."""
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")))
    return F.when(has_role(messages, "system"), messages).otherwise(F.concat(first, messages))


def render(messages: Column, template: dict[str, tuple[str, str]]) -> Column:
    """Training text: every message between its role's prefix and suffix."""
    prefix = F.create_map(*[F.lit(x) for r, (p, _) in template.items() for x in (r, p)])
    suffix = F.create_map(*[F.lit(x) for r, (_, s) in template.items() for x in (r, s)])
    return F.array_join(
        F.transform(
            messages, lambda m: F.concat(prefix[m["role"]], m["content"], suffix[m["role"]])
        ),
        "",
    )


def prompt_and_expected(messages: Column) -> Column:
    """``struct(prompt, expected)``: the first assistant message that answers a user message.

    ``prompt`` is the latest user message before it. Without such an answer ``expected`` is NULL and
    ``prompt`` is the last user message. An empty user message counts as none.
    """
    nothing = F.lit(None).cast("string")
    start = F.struct(nothing.alias("prompt"), nothing.alias("expected"))

    def step(state: Column, message: Column) -> Column:
        role, content = message["role"], message["content"]
        return (
            F.when(state["expected"].isNotNull(), state)
            .when(role == "user", F.struct(content.alias("prompt"), state["expected"].alias("expected")))
            .when(
                (role == "assistant") & (state["prompt"] != ""),
                F.struct(state["prompt"].alias("prompt"), content.alias("expected")),
            )
            .otherwise(state)
        )

    return F.aggregate(messages, start, step)


def generation_context(messages: Column) -> Column:
    """The messages before the first assistant message."""
    first = F.array_position(F.transform(messages, lambda m: m["role"]), "assistant")
    return F.when(first > 0, F.slice(messages, 1, (first - 1).cast("int"))).otherwise(messages)
