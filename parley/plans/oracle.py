"""SQL counterparts of the registered queries, for DuckDB.

Written independently of the Spark side: ordered string aggregation for fingerprints, exact text for
distinct answers, plain window functions for ranks, ``printf`` for rounding.
"""

from __future__ import annotations

from parley.functions.text import WHITESPACE
from parley.operators.manifest import GATED_PATTERNS
from parley.operators.recommend import (
    EDGE_POOL,
    MODEL_COLUMNS,
    MODELS,
    MULTILINGUAL_POOL,
    TARGETS,
    TASK_REASONS,
    TASK_SCORES,
    TASKS,
    TIE_ORDER,
)
from parley.operators.stats import PROMPT_TEMPLATES
from parley.plans.queries import ASKED_TARGETS, ASKED_TASKS, SYSTEM_PROMPT

# ---- inputs -------------------------------------------------------------------------------------

_CONVERSATIONS = (
    "SELECT 'chat-' || (conv_id % 4) AS dataset_id, conv_id, turn, role, text FROM conversations"
)


def _documents(by: str) -> str:
    head = f"SELECT '{by}-' || {by} AS dataset_id, doc_id AS conv_id"
    return (
        f"{head}, 0::BIGINT AS turn, 'user' AS role, lang AS text FROM documents UNION ALL "
        f"{head}, 1::BIGINT, 'assistant', text FROM documents"
    )


_JSON = (
    "SELECT 'json' AS dataset_id, conv_id, turn, role, CASE WHEN role = 'assistant' "
    "THEN '{\"answer\": \"' || text || '\"}' ELSE text END AS text FROM conversations"
)
_ALL = f"{_CONVERSATIONS} UNION ALL {_documents('lang')}"
_MANY = f"{_ALL} UNION ALL {_documents('source')}"


# The faults of ``broken_messages``; its gaps between turns change nothing, so they are left out here.
_BROKEN = f"""SELECT dataset_id, conv_id, turn,
    CASE WHEN turn = 1 AND conv_id % 6 = 0 THEN 'bot' WHEN turn = 1 AND conv_id % 6 = 1 THEN NULL ELSE role END AS role,
    CASE WHEN turn = 1 AND conv_id % 6 = 2 THEN NULL WHEN turn = 1 AND conv_id % 6 = 3 THEN ' \u3000' ELSE text END AS text
    FROM ({_ALL})"""


def _strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


_FEATURES = f"""
features AS (
  SELECT dataset_id, conv_id,
         count(*) AS n_messages,
         count(*) FILTER (role = 'user') AS n_user,
         count(*) FILTER (role = 'assistant') AS n_assistant,
         count(*) FILTER (role = 'system') AS n_system,
         sum(length(text))::BIGINT AS n_chars,
         coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS user_chars,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS assistant_chars,
         count(*) FILTER (role = 'assistant' AND length({_strip('text')}) = 0) AS blank_responses,
         count(*) FILTER (role = 'assistant' AND length({_strip('text')}) BETWEEN 1 AND 9) AS short_responses,
         count(*) FILTER (role = 'assistant' AND length({_strip('text')}) > 4000) AS long_responses,
         string_agg(role || ':' || substring(text, 1, 100), '|' ORDER BY turn) AS fp,
         string_agg(role || ':' || length(text) || ':' || text, '|' ORDER BY turn) AS full_fp
  FROM messages GROUP BY ALL
),
valid AS (
  SELECT * FROM features f WHERE n_messages >= 2 AND n_user > 0 AND n_assistant > 0 AND NOT EXISTS (
    SELECT 1 FROM messages m WHERE m.dataset_id = f.dataset_id AND m.conv_id = f.conv_id
      AND (role NOT IN ('system', 'user', 'assistant') OR length({_strip('text')}) = 0))
)"""


def _with(messages: str, *more: str) -> str:
    return f"WITH messages AS ({messages}), {', '.join([_FEATURES.strip(), *more])} "


def _one_decimal(x: str) -> str:
    return f"CAST(printf('%.1f', {x}) AS DOUBLE)"


def _integer(x: str) -> str:
    return f"CAST(printf('%.0f', {x}) AS BIGINT)"


# ---- statistics ---------------------------------------------------------------------------------

_STATS = f"""
stats AS (
  SELECT dataset_id, n AS total_examples, total_messages,
         {_one_decimal('total_messages / n')} AS avg_messages_per_example,
         chars // 4 AS total_tokens,
         (chars // 4) // n AS avg_tokens_per_example,
         {_integer('100.0::DOUBLE * single / n')} AS single_turn_pct,
         {_integer('100.0::DOUBLE * (n - single) / n')} AS multi_turn_pct,
         systems > 0 AS has_system_prompts,
         {_integer('100.0::DOUBLE * systems / n')} AS system_prompt_pct,
         {_integer('100.0::DOUBLE * with_system / n')} AS system_conv_pct,
         coalesce(user_chars // nullif(users, 0), 0) AS avg_input_chars,
         coalesce(assistant_chars // nullif(assistants, 0), 0) AS avg_output_chars,
         CASE WHEN n >= 500 AND coalesce(assistant_chars // nullif(assistants, 0), 0) > 50 THEN 'excellent'
              WHEN n >= 100 THEN 'good' ELSE 'minimal' END AS quality
  FROM (SELECT dataset_id, count(*) AS n, sum(n_messages)::BIGINT AS total_messages,
               sum(n_chars)::BIGINT AS chars,
               count(*) FILTER (n_user = 1 AND n_assistant = 1) AS single,
               sum(n_system)::BIGINT AS systems, count(*) FILTER (n_system > 0) AS with_system,
               sum(n_user)::BIGINT AS users, sum(n_assistant)::BIGINT AS assistants,
               sum(user_chars)::BIGINT AS user_chars, sum(assistant_chars)::BIGINT AS assistant_chars
        FROM valid GROUP BY dataset_id)
)"""

_HALF_UP_TOKENS = "CAST(floor(avg_output_chars / 4 + 0.5) AS BIGINT)"
_FAMILY = """
families AS (
  SELECT dataset_id, CASE WHEN t < 50 THEN 'classify' WHEN multi_turn_pct > 50 THEN 'conversation'
                          WHEN t > 200 THEN 'generation' ELSE 'qa' END AS family
  FROM (SELECT *, CAST(floor((CASE WHEN avg_output_chars = 0 THEN 200 ELSE avg_output_chars END) / 4 + 0.5)
                       AS BIGINT) AS t FROM stats)
)"""


def _values(rows: list[tuple]) -> str:
    def literal(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    return "VALUES " + ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)


# ---- quality ------------------------------------------------------------------------------------


def _quality(source: str) -> str:
    return f"""
counts AS (
  SELECT dataset_id, count(*) AS n_examples, count(*) - count(DISTINCT fp) AS duplicates,
         sum(blank_responses)::BIGINT AS blank_responses, sum(short_responses)::BIGINT AS short_responses,
         sum(long_responses)::BIGINT AS long_responses,
         count(*) FILTER (n_messages - n_system = 2) AS single_turn,
         count(*) FILTER (n_messages - n_system <> 2) AS multi_turn,
         count(*) FILTER (n_system > 0) AS with_system, count(*) FILTER (n_system = 0) AS without_system
  FROM {source} GROUP BY dataset_id
),
scored AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
      1.0::DOUBLE
      - least((duplicates::DOUBLE / n_examples) * 0.4::DOUBLE, 0.3::DOUBLE)
      - (CASE WHEN n_examples < 50 THEN 0.5 WHEN n_examples < 100 THEN 0.2
              WHEN n_examples < 500 THEN 0.1 ELSE 0.0 END)::DOUBLE
      - (CASE WHEN blank_responses > 0 THEN 0.2 ELSE 0.0 END)::DOUBLE
      - (CASE WHEN with_system > 0 AND without_system > 0 THEN 0.1 ELSE 0.0 END)::DOUBLE)) AS quality_score
  FROM counts
)"""


_ISSUES = """
issues AS (
  SELECT dataset_id, 1 AS o, 'duplicates' AS code, 'warning' AS severity, duplicates AS n,
         '⚠️ ' || duplicates || ' duplicate conversations (' || printf('%.0f', 100.0::DOUBLE * duplicates / n_examples) || '%)' AS message
  FROM scored WHERE duplicates > 0
  UNION ALL SELECT dataset_id, 2, 'too_few', 'error', n_examples, '❌ Too few examples (' || n_examples || '). Need at least 50.' FROM scored WHERE n_examples < 50
  UNION ALL SELECT dataset_id, 3, 'small', 'warning', n_examples, '⚠️ Small dataset (' || n_examples || '). 100+ recommended for better results.' FROM scored WHERE n_examples >= 50 AND n_examples < 100
  UNION ALL SELECT dataset_id, 4, 'medium', 'info', n_examples, '💡 ' || n_examples || ' examples. 500+ recommended for best results.' FROM scored WHERE n_examples >= 100 AND n_examples < 500
  UNION ALL SELECT dataset_id, 5, 'blank_responses', 'error', blank_responses, '❌ ' || blank_responses || ' empty assistant responses' FROM scored WHERE blank_responses > 0
  UNION ALL SELECT dataset_id, 6, 'short_responses', 'info', short_responses, '💡 ' || short_responses || ' short assistant responses (<10 chars) - fine if intentional' FROM scored WHERE short_responses > 0
  UNION ALL SELECT dataset_id, 7, 'long_responses', 'info', long_responses, '💡 ' || long_responses || ' very long responses (>4000 chars) - may need truncation' FROM scored WHERE long_responses > 0
  UNION ALL SELECT dataset_id, 8, 'mixed_format', 'info', multi_turn, '💡 Mixed format: ' || single_turn || ' single-turn, ' || multi_turn || ' multi-turn conversations' FROM scored WHERE single_turn > 0 AND multi_turn > 0
  UNION ALL SELECT dataset_id, 9, 'mixed_system', 'warning', without_system, '⚠️ Inconsistent: ' || with_system || ' with system prompt, ' || without_system || ' without' FROM scored WHERE with_system > 0 AND without_system > 0
)"""

# ---- profile ------------------------------------------------------------------------------------

_NORMALISED = f"lower({_strip('text')})"
_PROFILE = f"""
answers AS (
  SELECT m.*, {_NORMALISED} AS norm, {_strip('text')} AS stripped
  FROM messages m SEMI JOIN valid v ON m.dataset_id = v.dataset_id AND m.conv_id = v.conv_id
  WHERE role = 'assistant'
),
responses AS (
  SELECT dataset_id, count(*) AS distinct_responses,
         count(*) FILTER (regexp_matches(norm, '[^\\x00-\\x7F]')) AS non_ascii_responses
  FROM (SELECT DISTINCT dataset_id, norm FROM answers) GROUP BY dataset_id
),
json_flags AS (
  SELECT dataset_id, avg(CASE WHEN starts_with(stripped, '{{') OR starts_with(stripped, '[') THEN 1.0 ELSE 0.0 END) > 0.5
           AS looks_like_json_output
  FROM answers WHERE stripped <> '' GROUP BY dataset_id
),
profile AS (
  SELECT s.dataset_id, num_examples, users + assistants + systems AS total_messages,
         {_one_decimal('n_msgs / num_examples')} AS avg_messages_per_example,
         users AS user_messages, assistants AS assistant_messages, systems AS system_messages,
         {_integer('achars / assistants')} AS avg_response_length,
         {_integer('n_msgs / num_examples')} AS avg_conversation_length,
         single_turn, multi_turn, with_system, num_examples - with_system AS without_system,
         chars // 4 AS estimated_tokens, with_system > 0 AS has_system_prompts,
         multi_turn > single_turn AS is_multi_turn, distinct_responses, non_ascii_responses,
         distinct_responses > 0 AND distinct_responses < 20 AS looks_like_classification,
         non_ascii_responses / distinct_responses > 0.3 AS is_multilingual, looks_like_json_output
  FROM (SELECT dataset_id, count(*) AS num_examples, sum(n_messages)::BIGINT AS n_msgs,
               sum(n_user)::BIGINT AS users, sum(n_assistant)::BIGINT AS assistants,
               sum(n_system)::BIGINT AS systems, sum(assistant_chars)::BIGINT AS achars,
               sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_messages - n_system = 2) AS single_turn,
               count(*) FILTER (n_messages - n_system <> 2) AS multi_turn,
               count(*) FILTER (n_system > 0) AS with_system FROM valid GROUP BY dataset_id) s
  JOIN responses r USING (dataset_id) JOIN json_flags j USING (dataset_id)
)"""


def _responses(tail: str) -> str:
    return f"""WITH messages AS ({_MANY}),
d AS (SELECT dataset_id, {_NORMALISED} AS norm, min((conv_id, turn)) AS first_seen
      FROM messages WHERE role = 'assistant' GROUP BY ALL),
k AS (SELECT *, regexp_matches(norm, '[^\\x00-\\x7F]') AS wide,
             row_number() OVER (PARTITION BY dataset_id ORDER BY first_seen) AS pos FROM d)
{tail}"""


# ---- validation ---------------------------------------------------------------------------------


def _verdicts(messages: str) -> str:
    return f"""WITH messages AS ({messages}),
bad AS (
  SELECT dataset_id, conv_id, turn, role, CASE
      WHEN role IS NULL OR role NOT IN ('system', 'user', 'assistant') THEN 'role'
      WHEN text IS NULL THEN 'content_type'
      WHEN {_strip('text')} = '' THEN 'content_empty' END AS error
  FROM messages),
first_bad AS (SELECT * FROM bad WHERE error IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY dataset_id, conv_id ORDER BY turn) = 1),
judged AS (
  SELECT c.dataset_id, c.conv_id, n_messages, b.turn, b.role, CASE
      WHEN n_messages < 2 THEN 'too_few_messages' WHEN b.error IS NOT NULL THEN b.error
      WHEN NOT has_user THEN 'no_user' WHEN NOT has_assistant THEN 'no_assistant' END AS error_code
  FROM (SELECT dataset_id, conv_id, count(*) AS n_messages, bool_or(role = 'user') AS has_user,
               bool_or(role = 'assistant') AS has_assistant FROM messages GROUP BY ALL) c
  LEFT JOIN first_bad b ON b.dataset_id = c.dataset_id AND b.conv_id = c.conv_id),
verdicts AS (
  SELECT dataset_id, conv_id, n_messages, error_code,
    CASE WHEN error_code IN ('role', 'content_type', 'content_empty') THEN CAST(turn + 1 AS BIGINT) END AS msg_idx,
    CASE error_code
      WHEN 'too_few_messages' THEN 'Line ' || conv_id || ': need at least 2 messages (user + assistant)'
      WHEN 'role' THEN 'Line ' || conv_id || ', message ' || (turn + 1) || ': invalid role ''' || coalesce(role, 'None') || '''. Must be: system, user, or assistant'
      WHEN 'content_type' THEN 'Line ' || conv_id || ', message ' || (turn + 1) || ': ''content'' must be a string'
      WHEN 'content_empty' THEN 'Line ' || conv_id || ', message ' || (turn + 1) || ': ''content'' cannot be empty'
      WHEN 'no_user' THEN 'Line ' || conv_id || ': conversation must have at least one ''user'' message'
      WHEN 'no_assistant' THEN 'Line ' || conv_id || ': conversation must have at least one ''assistant'' message'
    END AS message
  FROM judged),
errors AS (SELECT dataset_id, conv_id, error_code, message,
                  row_number() OVER (PARTITION BY dataset_id ORDER BY conv_id) AS error_no
           FROM verdicts WHERE error_code IS NOT NULL)"""


def _gate(strict: bool, messages: str = _MANY) -> str:
    summary = (
        "(SELECT dataset_id, 'Validation failed:' || chr(10) || string_agg(message, chr(10) ORDER BY error_no) AS m "
        "FROM errors WHERE error_no <= 5 GROUP BY dataset_id)"
        if strict
        else "(SELECT NULL::VARCHAR AS dataset_id, NULL::VARCHAR AS m)"
    )
    return f"""{_verdicts(messages)},
gate AS (
  SELECT c.dataset_id, n_valid, n_errors, coalesce(s.m,
      CASE WHEN n_valid = 0 THEN 'File is empty or contains no valid examples.'
           WHEN n_valid < 50 THEN 'Need at least 50 examples for fine-tuning. Found only ' || n_valid || '.' END) AS error_msg
  FROM (SELECT dataset_id, count(*) FILTER (error_code IS NULL) AS n_valid,
               count(*) FILTER (error_code IS NOT NULL) AS n_errors FROM verdicts GROUP BY dataset_id) c
  LEFT JOIN {summary} s ON s.dataset_id = c.dataset_id)
"""


# What is wrong with each form of a line; the forms follow each other by document id.
# Broken JSON is found by its form: ``s`` is how long the text is as a JSON string, ``t`` the bare text.
_LINES = r"""
WITH forms(k, error_code, msg_idx, body) AS (VALUES
  (0, NULL, NULL::INTEGER, NULL),
  (1, 'invalid_json', NULL, NULL),
  (2, 'invalid_json', NULL, 'Extra data'),
  (3, 'not_object', NULL, 'must be a JSON object, got list'),
  (4, 'not_object', NULL, 'must be a JSON object, got str'),
  (5, 'not_object', NULL, 'must be a JSON object, got NoneType'),
  (6, 'no_messages', NULL, 'missing ''messages'' array'),
  (7, 'messages_not_array', NULL, '''messages'' must be an array'),
  (8, 'too_few_messages', NULL, 'need at least 2 messages (user + assistant)'),
  (9, 'message_not_object', 1, 'must be an object, got str'),
  (10, 'no_role', 2, 'missing ''role'' field'),
  (11, 'no_content', 2, 'missing ''content'' field'),
  (12, 'role', 2, 'invalid role ''bot''. Must be: system, user, or assistant'),
  (13, 'content_type', 1, '''content'' must be a string'),
  (14, 'content_empty', 2, '''content'' cannot be empty'),
  (15, 'no_user', NULL, 'conversation must have at least one ''user'' message'),
  (16, 'no_assistant', NULL, 'conversation must have at least one ''assistant'' message'),
  (17, NULL, NULL, NULL),
  (18, 'invalid_json', NULL, 'Expecting '','' delimiter'),
  (19, 'invalid_json', NULL, 'Expecting value'),
  (20, 'invalid_json', NULL, 'Expecting property name enclosed in double quotes'),
  (21, 'invalid_json', NULL, 'Unterminated string starting at'),
  (22, 'invalid_json', NULL, 'Expecting '':'' delimiter'),
  (23, 'invalid_json', NULL, 'Expecting '','' delimiter'),
  (24, 'invalid_json', NULL, 'Invalid \escape')),
docs AS (
  SELECT *, length(to_json(text)::VARCHAR) AS s, ltrim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM documents),
-- A bare text: a number at its head is a value with something behind it, any other head is none.
bare AS (SELECT *, regexp_extract(t, '^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][-+]?[0-9]+)?') AS number FROM docs),
judged AS (
  SELECT *, CASE WHEN k = 1 AND number <> '' THEN 'Extra data' WHEN k = 1 THEN 'Expecting value' ELSE body END AS reason,
    CASE k WHEN 1 THEN length(text) - length(t) + CASE WHEN number = '' THEN 0 ELSE length(t) - length(
        ltrim(substr(t, length(number) + 1), chr(32) || chr(9) || chr(10) || chr(13))) END
      WHEN 2 THEN s + 46 WHEN 18 THEN 2 * s + 16 WHEN 19 THEN s + 15 WHEN 20 THEN 1 WHEN 21 THEN s + 20 WHEN 22 THEN 12
      WHEN 23 THEN s + 21 WHEN 24 THEN s + 21 END AS char_no
  FROM bare JOIN forms ON k = doc_id % 25)
SELECT 'lang-' || lang AS dataset_id, doc_id AS line_no, error_code, msg_idx, char_no::BIGINT AS char_no,
  'Line ' || doc_id || coalesce(', message ' || msg_idx, '') || ': '
    || CASE WHEN error_code = 'invalid_json' THEN 'Invalid JSON - ' ELSE '' END || reason AS message
FROM judged"""

# ---- recommendation -----------------------------------------------------------------------------


def _recommend(tail: str) -> str:
    pools = [(t, m, None) for t, models in TARGETS.items() for m in models]
    pools += [("edge_device", m, s) for m, s in EDGE_POOL.items()]
    pools += [("multilingual", m, s) for m, s in MULTILINGUAL_POOL.items()]
    points = [(t, m[0], s) for t, *scores in TASK_SCORES for m, s in zip(MODELS, scores, strict=True)]
    ties = [(t, m, i) for t, models in TIE_ORDER.items() for i, m in enumerate(models)]
    tasks = ", ".join(f"'{t}'" for t in TASKS)
    targets = ", ".join(f"'{t}'" for t in ["edge_device", *TARGETS])
    return f"""{_with(_MANY, _PROFILE.strip())},
models({', '.join(MODEL_COLUMNS)}) AS ({_values(MODELS)}),
pools(pool, model_key, fixed_score) AS ({_values(pools)}),
points(score_task, model_key, task_points) AS ({_values(points)}),
ties(tie_task, model_key, priority) AS ({_values(ties)}),
task_reasons(model_key, user_task, task_reason) AS ({_values(TASK_REASONS)}),
requests AS (
  SELECT p.*, t.user_task, g.target,
    CASE WHEN is_multilingual THEN 'multilingual' WHEN g.target IN ({targets}) THEN g.target ELSE 'not_sure' END AS pool,
    CASE WHEN t.user_task IN ({tasks}) THEN t.user_task ELSE 'classify' END AS score_task,
    CASE WHEN t.user_task IN ({tasks}) THEN t.user_task ELSE 'default' END AS tie_task
  FROM profile p, ({_values([(t,) for t in ASKED_TASKS])}) t(user_task), ({_values([(t,) for t in ASKED_TARGETS])}) g(target)),
parts AS (
  SELECT r.*, m.*, o.fixed_score, task_points, priority,
    CASE WHEN num_examples < 500 THEN small WHEN num_examples >= 2000 THEN large ELSE medium END AS size_points,
    CASE WHEN avg_response_length > 200 THEN long_output WHEN looks_like_json_output THEN json_output ELSE 10 END AS output_points,
    CASE WHEN is_multi_turn THEN multi_turn_bonus ELSE 0 END AS bonus_points
  FROM requests r JOIN pools o ON o.pool = r.pool JOIN models m ON m.model_key = o.model_key
  JOIN points p ON p.score_task = r.score_task AND p.model_key = o.model_key
  JOIN ties t ON t.tie_task = r.tie_task AND t.model_key = o.model_key),
totals AS (SELECT *, coalesce(fixed_score, task_points + size_points + output_points + bonus_points) AS total FROM parts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, user_task, target ORDER BY total DESC, priority) AS rank FROM totals),
best AS (SELECT dataset_id, user_task, target, total AS b_total, train_minutes AS b_minutes, memory_gb AS b_memory,
                context_window AS b_context, model_id AS b_id, model_name AS b_name FROM ranked WHERE rank = 1)
{tail}"""


_MODEL_FIELDS = (
    "dataset_id, user_task, target, model_key, model_id, model_name, size, context_window, "
    "(context_window // 1000) || 'K' AS context_window_formatted, total::DOUBLE / 100 AS score"
)


def _reasons() -> str:
    phi, gemma, llama, qwen, mistral = (f"'{m[0]}'" for m in MODELS)
    primary = [
        "coalesce(task_reason, 'Strong performance for ' || r.user_task || ' tasks')",
        f"CASE WHEN r.model_key IN ({phi}, {mistral}) THEN 'Supports function calling' END",
        f"CASE WHEN r.model_key = {qwen} THEN 'Multilingual (29 languages)' END",
        f"CASE WHEN r.model_key IN ({gemma}, {llama}) THEN 'Optimized for on-device deployment' END",
        f"CASE WHEN r.model_key IN ({phi}, {llama}) THEN '128K token context window' "
        f"WHEN r.model_key = {qwen} THEN '32K token context window' END",
        f"CASE WHEN is_multi_turn AND r.model_key IN ({llama}, {mistral}) THEN 'Excellent at multi-turn context tracking' END",
        f"CASE WHEN num_examples < 500 AND r.model_key = {gemma} THEN 'Ideal for small datasets' "
        f"WHEN num_examples < 500 AND r.model_key = {phi} THEN 'Works well with limited data' "
        f"WHEN num_examples > 2000 AND r.model_key IN ({llama}, {mistral}) THEN 'Scales well with ' || format('{{:,}}', num_examples) || ' examples' END",
        f"CASE WHEN avg_response_length > 200 AND r.model_key IN ({llama}, {mistral}) THEN 'Optimized for longer outputs' "
        f"WHEN looks_like_json_output AND r.model_key = {phi} THEN 'Excellent JSON/structured output' END",
        f"CASE WHEN r.target IN ('mobile_app', 'ios_app', 'android_app') AND r.model_key IN ({phi}, {gemma}) THEN 'Optimized for mobile deployment' "
        f"WHEN r.target = 'web_browser' AND r.model_key IN ({phi}, {gemma}) THEN 'Runs efficiently in browser' END",
    ]
    alternative = [
        "CASE WHEN total >= b_total - 10 THEN 'Close match (' || total || '/100)' END",
        f"CASE WHEN r.model_key = {llama} THEN 'Requires HuggingFace approval (gated)' "
        f"WHEN r.model_key = {gemma} THEN 'Requires terms agreement (gated)' END",
        "CASE WHEN train_minutes < b_minutes THEN '~' || (b_minutes - train_minutes) || ' min faster training' END",
        "CASE WHEN memory_gb < b_memory THEN 'Lower VRAM (' || memory_gb || 'GB vs ' || b_memory || 'GB)' END",
        "CASE WHEN context_window > b_context THEN 'Larger context (' || (context_window // 1000) || 'K tokens)' END",
    ]
    return f""",
texts AS (
  SELECT r.dataset_id, r.user_task, r.target, rank, r.model_key,
    list_filter([{', '.join(primary)}], lambda x: x IS NOT NULL)[1:5] AS p,
    list_filter([{', '.join(alternative)}], lambda x: x IS NOT NULL) AS a, pool
  FROM ranked r JOIN best b ON b.dataset_id = r.dataset_id AND b.user_task = r.user_task AND b.target = r.target
  LEFT JOIN task_reasons t ON t.model_key = r.model_key AND t.user_task = r.user_task WHERE rank <= 3),
chosen AS (
  SELECT *, CASE
    WHEN rank = 1 AND pool = 'multilingual' THEN ['Best multilingual support (29 languages)', 'Optimized for non-English text']
    WHEN rank = 1 AND pool = 'edge_device' THEN ['Smallest model (2B params)', 'Optimized for low-power devices']
    WHEN rank = 1 THEN p WHEN pool = 'edge_device' OR len(a) = 0 THEN ['Good alternative'] ELSE a END AS reasons FROM texts)
SELECT dataset_id, user_task, target, rank, model_key,
       unnest(range(1, len(reasons) + 1)) AS reason_no, unnest(reasons) AS reason FROM chosen"""


def _manifest() -> str:
    gated = " OR ".join(f"contains(lower(base_model), '{p}')" for p in GATED_PATTERNS)
    picked = MODELS[0][1]
    return f""",
plans AS (
  SELECT b.*, p.num_examples, CASE WHEN b.target = 'mobile_app' THEN '{picked}' ELSE b_id END AS base_model,
         coalesce(a.model_name, b_name) AS model_name
  FROM best b JOIN profile p USING (dataset_id)
  LEFT JOIN ranked a ON a.dataset_id = b.dataset_id AND a.user_task = b.user_task AND a.target = b.target
       AND a.rank IN (2, 3) AND b.target = 'mobile_app' AND a.model_id = '{picked}'),
timed AS (
  SELECT p.*, (CASE m.size WHEN '2B' THEN 1.0 WHEN '3B' THEN 1.5 WHEN '3.8B' THEN 2.0 WHEN '7B' THEN 4.0
                 WHEN '8B' THEN 5.0 ELSE 2.0 END)::DOUBLE * (num_examples / 100) * 3 AS minutes
  FROM plans p LEFT JOIN models m ON m.model_id = p.base_model)
SELECT dataset_id, user_task, target, base_model, model_name,
  'Based on your ' || user_task || ' task and ' || target || ' deployment target, we recommend ' || model_name || '.' AS reasoning,
  './data.jsonl' AS data_path, './lora_adapter' AS output_dir, 2048 AS max_seq_length,
  16 AS r, 16 AS lora_alpha, 0 AS lora_dropout,
  CASE WHEN contains(lower(base_model), 'phi') THEN 'q_proj,k_proj,v_proj,o_proj,fc1,fc2'
       ELSE 'q_proj,k_proj,v_proj,o_proj,gate_proj,up_proj,down_proj' END AS target_modules,
  3 AS num_train_epochs, 4 AS per_device_train_batch_size, 4 AS gradient_accumulation_steps,
  0.0002::DOUBLE AS learning_rate, true AS fp16, 10 AS logging_steps, 'epoch' AS save_strategy,
  0.1::DOUBLE AS warmup_ratio, {gated} AS is_gated,
  CASE WHEN minutes < 5 THEN '~5 minutes' WHEN minutes < 30 THEN '~' || CAST(floor(minutes) AS BIGINT) || ' minutes'
       ELSE '~' || printf('%.1f', minutes / 60) || ' hours' END AS estimated_time
FROM timed"""


# ---- training data ------------------------------------------------------------------------------


def _pairs(messages: str) -> str:
    return f"""WITH messages AS ({messages}),
asked AS (
  SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (
      PARTITION BY dataset_id, conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u
  FROM messages),
answered AS (SELECT dataset_id, conv_id, u, text FROM asked WHERE role = 'assistant' AND u <> ''
             QUALIFY row_number() OVER (PARTITION BY dataset_id, conv_id ORDER BY turn) = 1),
last_user AS (SELECT dataset_id, conv_id, text FROM messages WHERE role = 'user'
              QUALIFY row_number() OVER (PARTITION BY dataset_id, conv_id ORDER BY turn DESC) = 1),
pairs AS (
  SELECT l.dataset_id, l.conv_id, coalesce(a.u, l.text) AS prompt, a.text AS expected
  FROM last_user l LEFT JOIN answered a ON a.dataset_id = l.dataset_id AND a.conv_id = l.conv_id
  WHERE coalesce(a.u, l.text) <> '')
"""


_CONTEXT = f"""WITH messages AS ({_ALL})
SELECT m.dataset_id, m.conv_id, m.turn, m.role, m.text FROM messages m
LEFT JOIN (SELECT dataset_id, conv_id, min(turn) AS bound FROM messages WHERE role = 'assistant' GROUP BY ALL) b
  ON b.dataset_id = m.dataset_id AND b.conv_id = m.conv_id
WHERE bound IS NULL OR m.turn < bound"""


def _prompted(messages: str) -> str:
    prompt = SYSTEM_PROMPT.strip()
    return f"""SELECT * FROM (WITH source AS ({messages}),
lacking AS (SELECT dataset_id, conv_id FROM source GROUP BY ALL HAVING NOT bool_or(role = 'system'))
SELECT s.dataset_id, s.conv_id, s.turn + (CASE WHEN l.conv_id IS NULL THEN 0 ELSE 1 END) AS turn, s.role, s.text
FROM source s LEFT JOIN lacking l ON l.dataset_id = s.dataset_id AND l.conv_id = s.conv_id
UNION ALL SELECT dataset_id, conv_id, 0::BIGINT, 'system', '{prompt}' FROM lacking)"""


_SNIP = "CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n}) || '...' ELSE {c} END"

# Lines of the documents, whose forms are known: two forms are valid, of two and of three messages.
_RUNNING = f"""{_LINES[: _LINES.index("docs AS (")]}
lines AS (
  SELECT 'lang-' || lang AS dataset_id, doc_id AS conv_id, text, lang,
    CASE WHEN doc_id % 40 = 0 THEN [0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24][
      1 + (doc_id // 40) % 24] ELSE 0 END AS k FROM documents),
numbered AS (
  SELECT l.*, error_code, msg_idx, body, row_number() OVER (PARTITION BY dataset_id ORDER BY conv_id) AS line_no
  FROM lines l JOIN forms f USING (k)),
valid AS (
  SELECT dataset_id, conv_id, CASE k WHEN 0 THEN 2 ELSE 3 END AS n_messages, 1 AS n_user, 1 AS n_assistant,
    CASE k WHEN 0 THEN 0 ELSE 1 END AS n_system, length(text) + CASE k WHEN 0 THEN 3 ELSE 2 END AS n_chars,
    CASE k WHEN 0 THEN 3 ELSE 1 END AS user_chars, CASE k WHEN 0 THEN length(text) ELSE 1 END AS assistant_chars
  FROM numbered WHERE error_code IS NULL AND NOT (k = 0 AND length({_strip('text')}) = 0))"""

_OVERALL = (
    _STATS.strip()
    .replace("stats AS", "whole AS", 1)
    .replace("SELECT dataset_id, count(*) AS n", "SELECT NULL::VARCHAR AS dataset_id, count(*) AS n")
    .replace("FROM valid GROUP BY dataset_id", "FROM valid")
)

_EXPORTED = f"""{_with(_CONVERSATIONS)},
lines AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY conv_id) AS line_no FROM features)
"""
_IS_VALID = "n_messages >= 2 AND n_user > 0 AND n_assistant > 0"


def all_oracles() -> dict[str, str]:
    by_lang_pairs = _pairs(_ALL)
    return {
        "conv_features": f"""{_with(_ALL)} SELECT * EXCLUDE (fp, full_fp), sha256(fp) AS fingerprint, sha256(full_fp) AS content_fingerprint, n_chars // 4 AS n_tokens,
            n_user = 1 AND n_assistant = 1 AS is_single_turn, n_messages - n_system = 2 AS is_two_message,
            n_system > 0 AS has_system FROM features""",
        "message_flags": f"""SELECT dataset_id, conv_id, turn, sha256({_NORMALISED}) AS response_hash,
            regexp_matches({_NORMALISED}, '[^\\x00-\\x7F]') AS non_ascii,
            starts_with({_strip('text')}, '{{') OR starts_with({_strip('text')}, '[') AS json_like,
            CASE WHEN length({_strip('text')}) = 0 THEN 'blank' WHEN length({_strip('text')}) < 10 THEN 'short'
                 WHEN length({_strip('text')}) > 4000 THEN 'very_long' ELSE 'normal' END AS band
            FROM ({_ALL}) WHERE role = 'assistant'""",
        "role_counts": f"""SELECT dataset_id, count(*) FILTER (role = 'system') AS system_messages,
            count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages,
            count(*) FILTER (role IN ('system', 'user', 'assistant')) AS total_messages FROM ({_ALL}) GROUP BY dataset_id""",
        "ingest_stats": f"{_with(_MANY, _STATS.strip())} SELECT * FROM stats",
        "dataset_warnings": f"""{_with(_MANY, _STATS.strip())}, w AS (
            SELECT dataset_id, 1 AS o, 'Long conversations may require truncation' AS warning FROM stats WHERE avg_tokens_per_example > 2000
            UNION ALL SELECT dataset_id, 2, 'More examples recommended for better results' FROM stats WHERE total_examples < 100
            UNION ALL SELECT dataset_id, 3, 'Consider adding system prompts for better control' FROM stats WHERE NOT has_system_prompts AND total_examples > 100)
            SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY o) AS warning_no, warning FROM w""",
        "training_time_band": f"""{_with(_MANY, _STATS.strip())} SELECT dataset_id, total_examples,
            {_HALF_UP_TOKENS} AS avg_response_tokens,
            CASE WHEN m > 30 THEN '25-35' WHEN m > 15 THEN '15-25' ELSE m || '-' || (m + 5) END AS training_minutes,
            NOT has_system_prompts AND total_examples >= 50 AS offer_system_prompt
            FROM (SELECT *, greatest(5, CAST(floor(total_examples / 50 + 0.5) AS BIGINT)) AS m FROM stats)""",
        "prompt_family": f"{_with(_MANY, _STATS.strip(), _FAMILY.strip())} SELECT * FROM families",
        "prompt_suggestions": f"""{_with(_MANY, _STATS.strip(), _FAMILY.strip())},
            t(family, suggestion_no, label, prompt) AS ({_values(PROMPT_TEMPLATES)})
            SELECT dataset_id, suggestion_no::BIGINT AS suggestion_no, t.family, label, prompt
            FROM families f JOIN t ON t.family = f.family OR t.family = 'general'""",
        "token_budget": f"""{_with(_MANY)} SELECT dataset_id, count(*) AS n_examples,
            count(*) FILTER (n_chars // 4 > 2048) AS over_budget, max(n_chars // 4) AS max_tokens,
            coalesce(sum(n_chars // 4 - 2048) FILTER (n_chars // 4 > 2048), 0)::BIGINT AS excess_tokens
            FROM features GROUP BY dataset_id""",
        "quality_score": f"{_with(_MANY, _quality('valid').strip())} SELECT * FROM scored",
        "quality_issues": f"""{_with(_MANY, _quality('valid').strip(), _ISSUES.strip())}
            SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY o) AS issue_no, code, severity, n, message FROM issues
            UNION ALL SELECT dataset_id, 1, 'ok', 'ok', n_examples, '✅ Data looks good!' FROM scored
            WHERE dataset_id NOT IN (SELECT dataset_id FROM issues)""",
        "duplicate_marks": f"""{_with(_ALL)} SELECT dataset_id, conv_id,
            row_number() OVER (PARTITION BY dataset_id, fp ORDER BY conv_id) > 1 AS is_duplicate,
            row_number() OVER (PARTITION BY dataset_id, full_fp ORDER BY conv_id) > 1 AS is_copy FROM features""",
        "dedup_conversations": f"""{_with(_ALL)}, kept AS (SELECT dataset_id, conv_id FROM features
            QUALIFY row_number() OVER (PARTITION BY dataset_id, full_fp ORDER BY conv_id) = 1)
            SELECT m.* FROM messages m SEMI JOIN kept k ON m.dataset_id = k.dataset_id AND m.conv_id = k.conv_id""",
        "dataset_profile": f"{_with(_MANY + ' UNION ALL ' + _JSON, _PROFILE.strip())} SELECT * FROM profile",
        "distinct_responses": _responses(
            "SELECT dataset_id, count(*) AS distinct_responses, count(*) < 20 AS looks_like_classification FROM k GROUP BY dataset_id"
        ),
        "sketched_flags": _responses(
            """SELECT dataset_id, count(*) < 20 AS looks_like_classification,
            count(*) FILTER (wide) / count(*) > 0.3 AS is_multilingual FROM k GROUP BY dataset_id"""
        ),
        "multilingual_flag": _responses(
            """SELECT dataset_id, count(*) AS distinct_responses, count(*) FILTER (wide) AS non_ascii_responses,
            count(*) FILTER (wide) / count(*) > 0.3 AS is_multilingual FROM k GROUP BY dataset_id"""
        ),
        "multilingual_flag_first_50": _responses(
            """SELECT dataset_id, count(*) AS distinct_responses, count(*) FILTER (wide AND pos <= 50) AS non_ascii_responses,
            count(*) FILTER (wide AND pos <= 50) / count(*) FILTER (pos <= 50) > 0.3 AS is_multilingual FROM k GROUP BY dataset_id"""
        ),
        "json_output_flag": f"""SELECT dataset_id, count(*) AS sampled_responses,
            count(*) FILTER (j) AS json_responses, count(*) FILTER (j) / count(*) > 0.5 AS looks_like_json_output
            FROM (SELECT dataset_id, starts_with({_strip('text')}, '{{') OR starts_with({_strip('text')}, '[') AS j,
                  row_number() OVER (PARTITION BY dataset_id ORDER BY conv_id, turn) AS k
                  FROM ({_ALL} UNION ALL {_JSON}) WHERE role = 'assistant' AND {_strip('text')} <> '')
            GROUP BY dataset_id""",
        "json_output_flag_first_50": f"""SELECT dataset_id, count(*) AS sampled_responses,
            count(*) FILTER (j) AS json_responses, count(*) FILTER (j) / count(*) > 0.5 AS looks_like_json_output
            FROM (SELECT dataset_id, starts_with({_strip('text')}, '{{') OR starts_with({_strip('text')}, '[') AS j,
                  row_number() OVER (PARTITION BY dataset_id ORDER BY conv_id, turn) AS k
                  FROM ({_ALL} UNION ALL {_JSON}) WHERE role = 'assistant' AND {_strip('text')} <> '')
            WHERE k <= 50 GROUP BY dataset_id""",
        "column_validation": f"{_verdicts(_ALL)} SELECT * FROM verdicts",
        "first_errors": f"{_verdicts(_ALL)} SELECT * FROM errors WHERE error_no <= 5",
        "broken_validation": f"{_verdicts(_BROKEN)} SELECT * FROM verdicts",
        "broken_first_errors": f"{_verdicts(_BROKEN)} SELECT * FROM errors WHERE error_no <= 5",
        "broken_gate": f"{_gate(True, _BROKEN)} SELECT dataset_id, n_valid, n_errors, error_msg IS NULL AS accepted, error_msg FROM gate",
        "dataset_gate": f"{_gate(True)} SELECT dataset_id, n_valid, n_errors, error_msg IS NULL AS accepted, error_msg FROM gate",
        "dataset_gate_quarantine": f"{_gate(False)} SELECT dataset_id, n_valid, n_errors, error_msg IS NULL AS accepted, error_msg FROM gate",
        "accepted_conversations": f"""{_gate(True)} SELECT v.dataset_id, v.conv_id, v.n_messages FROM verdicts v
            WHERE v.dataset_id IN (SELECT dataset_id FROM gate WHERE error_msg IS NULL)""",
        "rejected_datasets": f"{_gate(True)} SELECT dataset_id FROM gate WHERE error_msg IS NOT NULL",
        "line_validation": _LINES,
        "preview_rows": f"""WITH messages AS ({_ALL}), p AS (
            SELECT dataset_id, conv_id, row_number() OVER (PARTITION BY dataset_id ORDER BY conv_id) AS row_no
            FROM (SELECT DISTINCT dataset_id, conv_id FROM messages))
            SELECT m.*, row_no FROM messages m JOIN p ON m.dataset_id = p.dataset_id AND m.conv_id = p.conv_id WHERE row_no <= 5""",
        "sample_page": f"""SELECT dataset_id, conv_id, row_number() OVER (PARTITION BY dataset_id ORDER BY conv_id) AS row_no
            FROM (SELECT DISTINCT dataset_id, conv_id FROM ({_MANY})) QUALIFY row_no <= 100""",
        "page_totals": f"""SELECT dataset_id, count(DISTINCT conv_id) AS total_rows, least(100, count(DISTINCT conv_id)) AS returned_rows
            FROM ({_MANY}) GROUP BY dataset_id""",
        "positional_sample": f"""WITH c AS (
              SELECT dataset_id, conv_id, row_number() OVER (PARTITION BY dataset_id ORDER BY conv_id) - 1 AS position,
                     count(*) OVER (PARTITION BY dataset_id) AS n FROM (SELECT DISTINCT dataset_id, conv_id FROM ({_MANY}))),
            w AS (SELECT DISTINCT dataset_id, n, unnest([1, 2, 3, 4, 5]) AS sample_no FROM c)
            SELECT c.dataset_id, sample_no::BIGINT AS sample_no, c.position, c.conv_id FROM w JOIN c
              ON c.dataset_id = w.dataset_id AND c.position = CASE sample_no WHEN 1 THEN 0 WHEN 2 THEN w.n // 4
                 WHEN 3 THEN w.n // 2 WHEN 4 THEN (3 * w.n) // 4 ELSE w.n - 1 END""",
        "recommend_scores": _recommend(
            """SELECT dataset_id, user_task, target, model_key, task_points, size_points, output_points, bonus_points,
            total AS score, rank FROM ranked"""
        ),
        "recommend_primary": _recommend(
            f"""SELECT {_MODEL_FIELDS}, CASE WHEN total >= 80 THEN 'high' WHEN total >= 60 THEN 'medium' ELSE 'low' END AS confidence
            FROM ranked WHERE rank = 1"""
        ),
        "recommend_alternatives": _recommend(f"SELECT {_MODEL_FIELDS}, rank FROM ranked WHERE rank IN (2, 3)"),
        "recommend_reasons": _recommend(_reasons()),
        "recommend_all_scores": _recommend(
            """SELECT r.dataset_id, r.user_task, r.target, b_id AS primary_id,
            least(2, count(*) OVER (PARTITION BY r.dataset_id, r.user_task, r.target) - 1) AS n_alternatives,
            model_key, total::DOUBLE / 100 AS score
            FROM ranked r JOIN best b ON b.dataset_id = r.dataset_id AND b.user_task = r.user_task AND b.target = r.target"""
        ),
        "training_manifest": _recommend(_manifest()),
        "add_system_prompt": _prompted(_ALL),
        "added_prompt_counts": f"""SELECT dataset_id, count(*) AS n_examples, count(*) FILTER (NOT s) AS modified_count
            FROM (SELECT dataset_id, conv_id, bool_or(role = 'system') AS s FROM ({_ALL}) GROUP BY ALL) GROUP BY dataset_id""",
        "added_prompt_stats": f"{_with(_prompted(_CONVERSATIONS), _STATS.strip())} SELECT * FROM stats",
        "render_chat": f"""SELECT dataset_id, conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) AS text
            FROM ({_ALL}) GROUP BY ALL""",
        "prompt_expected_pairs": f"{by_lang_pairs} SELECT * FROM pairs",
        "prompt_expected_pairs_nested": f"{by_lang_pairs} SELECT * FROM pairs",
        "pair_snippets": f"""{by_lang_pairs} SELECT dataset_id, conv_id, {_SNIP.format(c='prompt', n=100)} AS prompt_snippet,
            {_SNIP.format(c='expected', n=50)} AS expected_snippet FROM pairs""",
        "generation_context": _CONTEXT,
        "generation_context_nested": _CONTEXT,
        "containment_accuracy": f"""{by_lang_pairs}, judged AS (
            SELECT dataset_id, coalesce(expected <> '' AND contains(
              lower(CASE WHEN conv_id % 3 = 0 THEN 'Answer: ' || lower(expected) || '.' ELSE prompt END),
              {_strip('lower(expected)')}), false) AS ok FROM pairs)
            SELECT dataset_id, count(*) AS total, count(*) FILTER (ok) AS correct,
              {_one_decimal('100.0::DOUBLE * count(*) FILTER (ok) / count(*)')} AS accuracy_pct FROM judged GROUP BY dataset_id""",
        "first_system_prompt": f"""WITH messages AS ({_ALL}), f AS (
            SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY conv_id, turn) = 1)
            SELECT dataset_id, CASE WHEN role = 'system' THEN text END AS system_prompt FROM f""",
        "jsonl_ingest": f"""{_EXPORTED} SELECT dataset_id, line_no AS conv_id, n_messages, n_user, n_assistant, n_system, n_chars,
            sha256(full_fp) AS content_fingerprint FROM lines WHERE {_IS_VALID}""",
        "ingest_summary": f"""{_EXPORTED} SELECT dataset_id, count(*) FILTER ({_IS_VALID}) AS n_valid,
            count(*) FILTER (NOT ({_IS_VALID})) AS n_errors,
            count(*) FILTER ({_IS_VALID}) >= 50 AND count(*) FILTER (NOT ({_IS_VALID})) = 0 AS accepted,
            count(*) FILTER ({_IS_VALID}) AS total_examples,
            sum(n_messages) FILTER ({_IS_VALID})::BIGINT AS total_messages FROM lines GROUP BY dataset_id""",
        "size_gate": f"""SELECT DISTINCT dataset_id, cap, true AS as_told
            FROM ({_CONVERSATIONS}), (VALUES ('none'), ('one byte')) AS c(cap)""",
        "file_gate": f"""SELECT DISTINCT dataset_id, 'extension' AS error_code,
            'Unsupported format: .txt. Please upload a .jsonl file.' AS message, true AS "some", 0::BIGINT AS kept
            FROM ({_CONVERSATIONS})""",
        "encoding_fallback": "SELECT doc_id, length(text) AS n_chars, sha256(text) AS text_hash FROM documents",
        "jsonl_scan": f"""{_EXPORTED} SELECT dataset_id, line_no, n_messages, n_chars, sha256(full_fp) AS content_fingerprint
            FROM lines WHERE {_IS_VALID}""",
        "jsonl_rejects": f"""{_EXPORTED} SELECT dataset_id, line_no,
            CASE WHEN n_messages < 2 THEN 'too_few_messages' WHEN n_user = 0 THEN 'no_user' ELSE 'no_assistant' END AS error_code,
            NULL::INTEGER AS msg_idx, 'Line ' || line_no || ': ' || CASE WHEN n_messages < 2 THEN 'need at least 2 messages (user + assistant)'
              WHEN n_user = 0 THEN 'conversation must have at least one ''user'' message'
              ELSE 'conversation must have at least one ''assistant'' message' END AS message
            FROM lines WHERE NOT ({_IS_VALID})""",
        "stream_ingest": f"""{_EXPORTED} SELECT dataset_id, n_messages, n_user, n_assistant, n_system, n_chars,
            sha256(full_fp) AS content_fingerprint, true AS own_key FROM lines WHERE {_IS_VALID}""",
        "stream_first_arrivals": f"""{_with(_documents('lang'))}
            SELECT DISTINCT dataset_id, sha256(full_fp) AS content_fingerprint FROM features""",
        "training_export": f"""SELECT dataset_id, 'microsoft/Phi-4-mini-instruct' AS base_model,
            './file=data.jsonl' AS data_path, './lora_adapter' AS output_dir, 2048 AS max_seq_length, 16 AS r,
            'q_proj,k_proj,v_proj,o_proj,fc1,fc2' AS target_modules, 3 AS num_train_epochs, 0.0002::DOUBLE AS learning_rate,
            count(DISTINCT conv_id) AS n_rows
            FROM ({_CONVERSATIONS}) GROUP BY dataset_id""",
        "export_commit": f"""SELECT dataset_id, unnest(['data.jsonl', 'config.json']) AS file,
            unnest([count(DISTINCT conv_id), 1]) AS n_rows, true AS has_text FROM ({_CONVERSATIONS}) GROUP BY dataset_id""",
        "stream_statistics": f"{_RUNNING}, {_STATS.strip()} SELECT * FROM stats",
        "stream_gate": f"""{_RUNNING}, errors AS (
            SELECT dataset_id, 'Line ' || line_no || coalesce(', message ' || msg_idx, '') || ': '
              || CASE WHEN error_code = 'invalid_json' THEN 'Invalid JSON - ' ELSE '' END || body AS message, line_no
            FROM numbered WHERE error_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY line_no) <= 5),
            told AS (SELECT dataset_id, 'Validation failed:' || chr(10) || string_agg(message, chr(10) ORDER BY line_no) AS m
              FROM errors GROUP BY dataset_id),
            counts AS (SELECT dataset_id, count(*) FILTER (error_code IS NULL) AS n_valid,
              count(*) FILTER (error_code IS NOT NULL) AS n_errors FROM numbered GROUP BY dataset_id)
            SELECT dataset_id, n_valid, n_errors, error_msg IS NULL AS accepted, error_msg FROM (
              SELECT c.*, coalesce(m, CASE WHEN n_valid = 0 THEN 'File is empty or contains no valid examples.'
                WHEN n_valid < 50 THEN 'Need at least 50 examples for fine-tuning. Found only ' || n_valid || '.' END) AS error_msg
              FROM counts c LEFT JOIN told t USING (dataset_id))""",
        "stream_kept": f"""{_RUNNING} SELECT dataset_id, line_no, n_messages FROM valid JOIN numbered USING (dataset_id, conv_id)
            QUALIFY row_number() OVER (PARTITION BY dataset_id, n_messages, text ORDER BY line_no) = 1""",
        "ingest_again": f"""{_RUNNING}, {_STATS.strip()}, counts AS (
              SELECT dataset_id, count(*) FILTER (error_code IS NULL) AS n_valid,
                count(*) FILTER (error_code IS NOT NULL) AS n_errors FROM numbered GROUP BY dataset_id)
            SELECT dataset_id, n_valid, n_errors, n_valid >= 50 AS accepted, total_messages, total_tokens
            FROM counts LEFT JOIN stats USING (dataset_id)""",
        "stats_rollup": f"""{_with(_MANY, _STATS.strip(), _OVERALL)} SELECT *, false AS is_overall FROM stats
            UNION ALL SELECT *, true FROM whole""",
        "quality_rollup": f"""{_with(_MANY, _quality('valid').strip())}, each AS (SELECT * FROM scored)
            SELECT *, false AS is_overall FROM each UNION ALL
            (WITH {_quality("(SELECT * REPLACE (NULL::VARCHAR AS dataset_id) FROM valid)").strip()} SELECT *, true FROM scored)""",
    }
