from __future__ import annotations

import random

from pyspark.sql import functions as F

from parley.operators import dedup, features, profile, quality, stats
from parley.operators.features import (
    chat_features,
    conversation_features,
    facts_of_valid,
    message_facts,
    valid_only,
)
from parley.operators.shape import explode_messages, nest_messages

WORDS = ["alpha", "béta", "  gamma ", "{\"x\": 1}", "[1]", "Yes", "no", "é" * 30, "w" * 150, "z" * 4100]


def random_datasets(seed):
    rng = random.Random(seed)

    def conversation():
        roles = rng.choice(["ua", "ua", "sua", "uaua", "suaua", "uas", "uua", "auua"])
        names = {"s": "system", "u": "user", "a": "assistant"}
        return [(names[r], " ".join(rng.choices(WORDS, k=rng.randint(1, 2)))) for r in roles]

    data = {}
    for name, n in [("tiny", 7), ("fifty", 50), ("hundred", 101), ("large", 520)]:
        conversations = [conversation() for _ in range(n)]
        for i in range(0, n, 9):
            conversations[i] = conversations[0]
        data[name] = conversations
    data["single"] = [[("user", f"q{i}"), ("assistant", "Yes" if i % 2 else "No")] for i in range(60)]
    return data


def test_shapes_are_inverse(chats_of):
    chats = chats_of(random_datasets(1))
    again = nest_messages(explode_messages(chats).repartition(7, "turn"))
    rows = lambda df: sorted((r.dataset_id, r.conv_id, [tuple(m) for m in r.messages]) for r in df.collect())
    assert rows(chats) == rows(again)


def test_both_shapes_give_the_same_features(chats_of):
    chats = chats_of(random_datasets(2))
    nested = chat_features(chats)
    columns = [c for c in nested.columns if "fingerprint" not in c]
    spread = explode_messages(chats).repartition(9, "text")
    rows_of = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    exploded = conversation_features(message_facts(spread))
    assert rows_of(nested) == rows_of(exploded)
    # Fingerprints differ in value, not in what they tell apart.
    pairs = nested.select("dataset_id", "conv_id", F.col("fingerprint").alias("a")).join(
        exploded.select("dataset_id", "conv_id", F.col("fingerprint").alias("b")), ["dataset_id", "conv_id"]
    )
    a, b, both = pairs.agg(F.count_distinct("a"), F.count_distinct("b"), F.count_distinct("a", "b")).first()
    assert a == b == both


def test_single_turn_forms_agree_on_valid_data(chats_of):
    found = valid_only(conversation_features(message_facts(explode_messages(chats_of(random_datasets(3))))))
    assert found.where("is_single_turn <> is_two_message").count() == 0


def expected_stats(conversations):
    """An independent reading of the definitions, over Python lists."""
    n = len(conversations)
    texts = {r: [c for conv in conversations for role, c in conv if role == r] for r in ("system", "user", "assistant")}
    chars = sum(len(c) for conv in conversations for _, c in conv)
    mean = lambda values: sum(map(len, values)) // len(values) if values else 0
    single = sum(sorted(r for r, _ in conv if r != "system") == ["assistant", "user"] for conv in conversations)
    total = sum(map(len, conversations))
    output = mean(texts["assistant"])
    return {
        "total_examples": n,
        "total_messages": total,
        "avg_messages_per_example": round(total / n, 1),
        "total_tokens": chars // 4,
        "avg_tokens_per_example": chars // 4 // n,
        "single_turn_pct": round(100 * single / n),
        "multi_turn_pct": round(100 * (n - single) / n),
        "has_system_prompts": bool(texts["system"]),
        "system_prompt_pct": round(100 * len(texts["system"]) / n),
        "avg_input_chars": mean(texts["user"]),
        "avg_output_chars": output,
        "quality": "excellent" if n >= 500 and output > 50 else "good" if n >= 100 else "minimal",
    }


def test_statistics_agree_with_definitions(chats_of):
    data = random_datasets(4)
    got = stats.ingest_stats(chat_features(chats_of(data)))
    rows = {r.dataset_id: r.asDict() for r in got.collect()}
    for name, conversations in data.items():
        want = expected_stats(conversations)
        assert {k: rows[name][k] for k in want} == want, name


def test_warnings_and_estimates(spark):
    columns = "dataset_id string, total_examples bigint, avg_tokens_per_example bigint, has_system_prompts boolean, avg_output_chars bigint, multi_turn_pct bigint"
    rows = [
        ("a", 99, 2001, False, 202, 0),
        ("b", 100, 2000, False, 0, 51),
        ("c", 101, 0, False, 198, 51),
        ("d", 49, 0, False, 802, 50),
        ("e", 775, 0, True, 801, 50),
        ("f", 1525, 0, True, 198, 0),
        ("g", 1526, 0, True, 0, 0),
    ]
    df = spark.createDataFrame(rows, columns)
    found = {}
    for r in stats.dataset_warnings(df).orderBy("dataset_id", "warning_no").collect():
        found.setdefault(r.dataset_id, []).append(r.warning.split()[0])
    assert found == {"a": ["Long", "More"], "c": ["Consider"], "d": ["More"]}
    est = {r.dataset_id: r for r in stats.training_estimates(df).collect()}
    assert {k: r.training_minutes for k, r in est.items()} == {
        "a": "5-10", "b": "5-10", "c": "5-10", "d": "5-10", "e": "15-25", "f": "25-35", "g": "25-35",
    }
    assert est["a"].avg_response_tokens == 51 and est["d"].avg_response_tokens == 201
    assert {k for k, r in est.items() if r.offer_system_prompt} == {"a", "b", "c"}
    family = {r.dataset_id: r.family for r in stats.prompt_family(df).collect()}
    assert family == {"a": "qa", "b": "conversation", "c": "conversation", "d": "generation", "e": "qa", "f": "qa", "g": "qa"}
    offered = {r["dataset_id"]: r["count"] for r in stats.prompt_suggestions(df).groupBy("dataset_id").count().collect()}
    assert set(offered.values()) == {3}


def test_quality_issues_and_score(chats_of, spark):
    u, a = ("user", "q"), ("assistant", "a long enough answer")
    data = {
        "clean": [[("user", f"q{i}"), a] for i in range(500)],
        "dups": [[u, a]] * 60,
        "all": [[("user", f"q{i}"), ("assistant", "short")] for i in range(40)]
        + [[("system", "s"), u, ("assistant", "x" * 4001), u, ("assistant", " ")]] * 10,
    }
    ids = spark.createDataFrame([(k,) for k in [*data, "none"]], "dataset_id string")
    scored = quality.quality_score(chat_features(chats_of(data)), ids)
    score = {r.dataset_id: r.quality_score for r in scored.collect()}
    assert score["clean"] == 1.0 and score["none"] == 0.0
    assert score["dups"] == 1.0 - 0.3 - 0.2
    assert score["all"] == 1.0 - 9 / 50 * 0.4 - 0.2 - 0.2 - 0.1
    issues = {}
    for r in quality.quality_issues(scored).orderBy("dataset_id", "issue_no").collect():
        issues.setdefault(r.dataset_id, []).append(r.message)
    assert issues["clean"] == ["✅ Data looks good!"]
    assert issues["none"] == ["No data available"]
    assert issues["dups"] == [
        "⚠️ 59 duplicate conversations (98%)",
        "⚠️ Small dataset (60). 100+ recommended for better results.",
    ]
    assert issues["all"] == [
        "⚠️ 9 duplicate conversations (18%)",
        "⚠️ Small dataset (50). 100+ recommended for better results.",
        "❌ 10 empty assistant responses",
        "💡 40 short assistant responses (<10 chars) - fine if intentional",
        "💡 10 very long responses (>4000 chars) - may need truncation",
        "💡 Mixed format: 40 single-turn, 10 multi-turn conversations",
        "⚠️ Inconsistent: 10 with system prompt, 40 without",
    ]


def test_fingerprint_looks_at_the_first_hundred_characters(chats_of):
    head = "x" * 100
    data = {"d": [
        [("user", head + "1"), ("assistant", "a")],
        [("user", head + "2"), ("assistant", "a")],
        [("user", head[:-1] + "y"), ("assistant", "a")],
        [("assistant", "a"), ("user", head + "1")],
        [("user", head), ("assistant", "a"), ("user", "more")],
    ]}
    chats = chats_of(data)
    messages = explode_messages(chats).repartition(5)
    for found in (chat_features(chats), conversation_features(message_facts(messages))):
        marks = {r.conv_id: (r.is_duplicate, r.is_copy) for r in dedup.mark_duplicates(found).collect()}
        # Alike in the first hundred characters is counted; only what is the same in full is removed.
        assert marks == {0: (False, False), 1: (True, False), 2: (False, False), 3: (False, False), 4: (False, False)}
        assert dedup.drop_duplicates(chats, found).count() == 5


def test_null_is_not_empty_and_not_nothing(spark):
    schema = "dataset_id string, conv_id bigint, messages array<struct<role: string, content: string>>"
    rows = [("d", k, [("user", "a"), ("assistant", c)][: 2 - (k == 2)]) for k, c in enumerate([None, "", "x"])]
    chats = spark.createDataFrame(rows, schema)
    nested = {r.conv_id: r for r in chat_features(chats).collect()}
    assert [nested[k].n_chars for k in range(3)] == [1, 1, 1]
    assert len({nested[k].content_fingerprint for k in range(3)}) == 3
    assert nested[0].fingerprint == nested[1].fingerprint != nested[2].fingerprint
    flat = conversation_features(message_facts(explode_messages(chats))).collect()
    assert len({r.content_fingerprint for r in flat}) == 3


def test_errors_name_messages_by_place(spark):
    from parley.operators.validate import validate_messages

    rows = [("d", 1, 10, "user", "a"), ("d", 1, 20, "bot", "b"), ("d", 1, 30, "bot", "c"), ("d", 2, -3, None, "x"), ("d", 2, 7, "user", " ")]
    found = spark.createDataFrame(rows, "dataset_id string, conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.msg_idx, r.message) for r in validate_messages(found).collect()}
    assert got[1][0] == 2 and got[1][1].startswith("Line 1, message 2: ")
    assert got[2][0] == 1


def test_removing_duplicates_leaves_none(chats_of):
    chats = chats_of(random_datasets(5))
    kept = dedup.drop_duplicates(chats, chat_features(chats))
    marks = dedup.mark_duplicates(chat_features(kept))
    assert marks.where("is_copy").count() == 0
    firsts = {(r.dataset_id, r.conv_id) for r in kept.collect()}
    assert ("large", 0) in firsts and ("large", 9) not in firsts


def test_profile_agrees_with_definitions(chats_of):
    data = random_datasets(6)
    facts = message_facts(explode_messages(chats_of(data)).repartition(6, "text"))
    for reuse in (False, True):
        rows = {r.dataset_id: r for r in profile.dataset_profile(facts, reuse=reuse).collect()}
        for name, conversations in data.items():
            answers = [c for conv in conversations for r, c in conv if r == "assistant"]
            distinct = {a.strip().lower() for a in answers}
            head = [a.strip() for a in answers if a.strip()]
            multi = sum(sum(r != "system" for r, _ in conv) != 2 for conv in conversations)
            r = rows[name]
            assert r.distinct_responses == len(distinct)
            assert r.looks_like_classification == (0 < len(distinct) < 20)
            assert r.is_multilingual == (sum(not d.isascii() for d in distinct) / len(distinct) > 0.3)
            assert r.looks_like_json_output == (sum(a[0] in "{[" for a in head) / len(head) > 0.5)
            assert r.avg_response_length == round(sum(map(len, answers)) / len(answers))
            assert r.multi_turn == multi and r.is_multi_turn == (multi > len(conversations) - multi)


def test_multilingual_sample_takes_first_appearances(chats_of):
    answers = [f"plain {i}" for i in range(40)] + [f"é {i}" for i in range(60)]
    data = {"d": [[("user", "q"), ("assistant", a)] for a in answers] + [[("user", "q"), ("assistant", "plain 0")]]}
    facts = message_facts(explode_messages(chats_of(data)))
    assert profile.response_profile(facts).first().is_multilingual is True
    assert profile.response_profile(facts, 50).first().is_multilingual is False


def test_invalid_conversations_are_left_out(chats_of):
    data = {"d": [
        [("user", "a"), ("assistant", "b")],
        [("user", "a")],
        [("user", "a"), ("user", "b")],
        [("assistant", "a"), ("assistant", "b")],
        [("user", " "), ("assistant", "b")],
        [("User", "a"), ("user", "a"), ("assistant", "b")],
    ]}
    facts = message_facts(explode_messages(chats_of(data)))
    assert [r.conv_id for r in valid_only(conversation_features(facts)).collect()] == [0]
    assert facts_of_valid(facts).count() == 2


def test_budget(chats_of):
    data = {"d": [[("user", "q" * 4 * n), ("assistant", "abc")] for n in (2047, 2048, 2049)]}
    row = features.token_budget(chat_features(chats_of(data)), 2048).first()
    assert (row.n_examples, row.over_budget, row.max_tokens, row.excess_tokens) == (3, 1, 2049, 1)
