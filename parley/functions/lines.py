"""Strict parsing and validation of one JSONL line as column expressions.

The rules are checked in a fixed order and the first one broken names the line's error. JSON is held as
VARIANT, whose types can be told apart before anything is extracted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.json_errors import json_error
from parley.schema import MIN_MESSAGES, ROLES

# How the JSON types are called in messages.
_TYPE_NAMES = [
    ("OBJECT%", "dict"),
    ("ARRAY%", "list"),
    ("STRING", "str"),
    ("BIGINT", "int"),
    ("BOOLEAN", "bool"),
    ("VOID", "NoneType"),
    ("DECIMAL%", "float"),
    ("DOUBLE", "float"),
]
# Error code and message body of every rule, in the order the rules apply.
LINE_RULES = {
    "invalid_json": "Invalid JSON - %s",
    "not_object": "must be a JSON object, got %s",
    "no_messages": "missing 'messages' array",
    "messages_not_array": "'messages' must be an array",
    "too_few_messages": "need at least 2 messages (user + assistant)",
}
# Where only this parser objects: to depth, or to numbers beyond its range.
NO_VALUE = "the line is not one JSON value"
MESSAGE_RULES = {
    "message_not_object": "must be an object, got %s",
    "no_role": "missing 'role' field",
    "no_content": "missing 'content' field",
    "role": "invalid role '%s'. Must be: system, user, or assistant",
    "content_type": "'content' must be a string",
    "content_empty": "'content' cannot be empty",
}
ROLE_RULES = {
    "no_user": "conversation must have at least one 'user' message",
    "no_assistant": "conversation must have at least one 'assistant' message",
}


def _wrapped(line: Column, nonce: str) -> Column:
    """The line inside an array before a marker no line can know.

    The parser stops after the first value and ignores what follows; wrapped, trailing text either
    breaks the array or changes its length.
    """
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit(f',"{nonce}"]')))


def _unwrapped(wrapped: Column, nonce: str) -> Column:
    """The line as VARIANT, or NULL unless the whole line is exactly one JSON value."""
    marker = F.try_variant_get(wrapped, "$[1]", "string")
    third = F.try_variant_get(wrapped, "$[2]", "variant")
    return F.when((marker == nonce) & third.isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def _type_name(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    name = F.lit("float")
    for pattern, python in reversed(_TYPE_NAMES):
        name = F.when(schema.like(pattern), python).otherwise(name)
    return name


def _is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _field(value: Column, name: str) -> Column:
    """A member as VARIANT: SQL NULL when missing, a JSON null when null."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def _shown(value: Column) -> Column:
    """A role as it is quoted in a message."""
    kind = F.schema_of_variant(value)
    plain = F.to_json(value)
    return (
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        .when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(plain))
        .otherwise(plain)
    )


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).like("OBJECT%")


def _string_of(value: Column) -> Column:
    """The text of a string value; NULL for every other type, which a plain extraction would convert."""
    return F.when(_is_string(value), F.try_variant_get(value, "$", "string"))


def _members(item: Column) -> Column:
    return F.struct(
        item.alias("item"),
        _field(item, "role").alias("role"),
        _field(item, "content").alias("content"),
    )


def _texts(message: Column) -> Column:
    return F.struct(
        message["item"].alias("item"),
        message["role"].alias("role"),
        message["content"].alias("content"),
        _string_of(message["role"]).alias("role_text"),
        _string_of(message["content"]).alias("content_text"),
    )


def _message_code(message: Column) -> Column:
    known = F.coalesce(message["role_text"].isin(*ROLES), F.lit(False))
    return (
        F.when(message["role"].isNull() & ~_is_object(message["item"]), "message_not_object")
        .when(message["role"].isNull(), "no_role")
        .when(message["content"].isNull(), "no_content")
        .when(~known, "role")
        .when(message["content_text"].isNull(), "content_type")
        .when(T.is_blank(message["content_text"]), "content_empty")
    )


def judge_lines(lines: DataFrame) -> DataFrame:
    """Add ``messages, raw, error_code, msg_idx, char_no, detail, body`` to a table with ``line``.

    ``error_code`` is NULL for a valid line. Of a line that is no JSON, ``detail`` is the parser's reason and
    ``char_no`` the character, from 0, at which it stops. Projections only: nothing is shuffled. Each step is
    a projection of its own because its result is used several times by the next.
    """
    # The last of duplicate keys wins; without this setting such lines would not parse.
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    nonce = uuid.uuid4().hex
    entry, member, items, read = (F.col(c) for c in ("_entry", "_member", "_items", "_read"))
    parsed = (
        lines.withColumn("_wrapped", _wrapped(F.col("line"), nonce))
        .withColumn("_entry", _unwrapped(F.col("_wrapped"), nonce))
        .withColumn("_member", _field(entry, "messages"))
        .withColumn("_items", F.try_variant_get(member, "$", "array<variant>"))
        .withColumn("_seen", F.transform(items, _members))
        .withColumn("_read", F.transform("_seen", _texts))
        .withColumn("_codes", F.transform(read, _message_code))
        .withColumn(
            "_bad",
            F.array_position(F.transform("_codes", lambda c: c.isNotNull()), True).cast("int"),
        )
    )

    def has(role: str) -> Column:
        return F.exists(read, lambda m: m["role_text"] == role)

    in_message = F.col("_bad") > 0
    code = (
        F.when(entry.isNull(), "invalid_json")
        .when(member.isNull() & ~_is_object(entry), "not_object")
        .when(member.isNull(), "no_messages")
        .when(items.isNull(), "messages_not_array")
        .when(F.size(items) < MIN_MESSAGES, "too_few_messages")
        .when(in_message, F.get("_codes", F.col("_bad") - 1))
        .when(~has("user"), "no_user")
        .when(~has("assistant"), "no_assistant")
    )
    parsed = parsed.withColumn("error_code", code)
    failed = F.col("error_code")
    broken = F.get(read, F.col("_bad") - 1)
    # Only for broken lines is the text gone through again, character by character.
    parsed = parsed.withColumn("_stop", F.when(failed == "invalid_json", json_error(F.col("line"))))
    parsed = parsed.withColumns(
        {
            "msg_idx": F.when(failed.isin(*MESSAGE_RULES), F.col("_bad")),
            "char_no": F.col("_stop.at"),
            "detail": F.when(failed == "invalid_json", F.coalesce("_stop.reason", F.lit(NO_VALUE)))
            .when(failed == "not_object", _type_name(entry))
            .when(failed == "message_not_object", _type_name(broken["item"]))
            .when(failed == "role", _shown(broken["role"])),
        }
    )
    bodies = F.create_map(
        *[F.lit(x) for rule in {**LINE_RULES, **MESSAGE_RULES, **ROLE_RULES}.items() for x in rule]
    )
    body = F.replace(bodies[failed], F.lit("%s"), F.coalesce("detail", F.lit("")))
    messages = F.transform(
        read, lambda m: F.struct(m["role_text"].alias("role"), m["content_text"].alias("content"))
    )
    return parsed.withColumns(
        {
            "messages": F.when(failed.isNull(), messages),
            "raw": F.when(failed.isNull(), entry),
            "body": F.when(failed.isNotNull(), body),
        }
    ).drop("_wrapped", "_entry", "_member", "_items", "_seen", "_read", "_codes", "_bad", "_stop")


def line_message(line_no: Column, msg_idx: Column, body: Column) -> Column:
    """The text of an error, with the place before it; NULL where there is none."""
    place = F.when(msg_idx.isNotNull(), F.format_string("Line %d, message %d: ", line_no, msg_idx))
    return F.concat(place.otherwise(F.format_string("Line %d: ", line_no)), body)


def validate_lines(lines: DataFrame) -> DataFrame:
    """:func:`judge_lines` for a table with ``line_no``: ``message`` names the line and takes the place of ``body``."""
    message = line_message(F.col("line_no"), F.col("msg_idx"), F.col("body"))
    return judge_lines(lines).withColumn("message", message).drop("body")


def lines_where(validated: DataFrame, condition: Column) -> DataFrame:
    """Filter validated lines by the outcome.

    The optimizer moves a filter below the projections it depends on and so would parse every line a
    second time there; it does not do so past a random column.
    """
    return (
        validated.withColumn("_here", F.rand())
        .where(condition & (F.col("_here") >= 0.0))
        .drop("_here")
    )
