"""Canonical schemas and the fixed values of the data contract.

Two equivalent shapes are used throughout:

``chats``
    one row per conversation: ``dataset_id, conv_id, [line_no,] messages, [raw]``
``messages``
    one row per message: ``dataset_id, conv_id, turn, role, text``; ``turn`` is the message's
    0-based position in its conversation

A conversation is one training example - one line of a JSONL file - and so fits a row.
Datasets, groups of duplicates and groups of equal answers have no such bound.
"""

from __future__ import annotations

CHATS_SCHEMA = (
    "dataset_id STRING, conv_id BIGINT, line_no BIGINT, "
    "messages ARRAY<STRUCT<role: STRING, content: STRING>>, raw VARIANT"
)
MESSAGES_SCHEMA = "dataset_id STRING, conv_id BIGINT, turn BIGINT, role STRING, text STRING"
REJECTS_SCHEMA = (
    "dataset_id STRING, line_no BIGINT, error_code STRING, msg_idx INT, detail STRING, message STRING"
)

CONV_KEY = ["dataset_id", "conv_id"]

# The contract of a valid conversation and of an acceptable dataset.
ROLES = ("system", "user", "assistant")
MIN_MESSAGES = 2
MIN_EXAMPLES = 50
MAX_FILE_BYTES = 100 * 1024 * 1024
ERRORS_SHOWN = 5
PREVIEW_ROWS = 5
SAMPLE_ROWS = 100

# Thresholds of the quality checks and of the profile.
PREFIX_CHARS = 100
SHORT_RESPONSE = 10
LONG_RESPONSE = 4000
RESPONSE_SAMPLE = 50
CLASSIFICATION_MAX_DISTINCT = 20
MULTILINGUAL_SHARE = 0.3
JSON_SHARE = 0.5
TOKEN_BUDGET = 2048
