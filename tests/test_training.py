from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from parley.functions import conversation as C
from parley.operators import rewrite, training
from parley.operators.first import first_rows, rows_at_quarters
from parley.operators.shape import explode_messages, nest_messages
from parley.operators.validate import validate_messages

S, U, A = "system", "user", "assistant"


def as_lists(chats):
    return {(r.dataset_id, r.conv_id): [tuple(m) for m in r.messages] for r in chats.collect()}


PAIRS = {
    "plain": ([(U, "a"), (A, "b"), (U, "c"), (A, "d")], ("a", "b")),
    "system first": ([(S, "s"), (U, "a"), (A, "b")], ("a", "b")),
    "last user counts": ([(U, "a"), (U, "b"), (S, "s"), (A, "c")], ("b", "c")),
    "assistant first": ([(A, "x"), (U, "a"), (A, "b")], ("a", "b")),
    "no answer": ([(A, "x"), (U, "a"), (U, "b")], ("b", None)),
    "no user": ([(A, "x"), (S, "a")], None),
    "empty user": ([(U, "a"), (U, ""), (A, "x"), (U, "b"), (A, "y")], ("b", "y")),
    "only empty user": ([(U, ""), (A, "x")], None),
    "empty answer ends": ([(U, "a"), (A, ""), (U, "b"), (A, "c")], ("a", "")),
}


def test_prompt_pairs_in_both_shapes(chats_of):
    chats = chats_of({name: [conv] for name, (conv, _) in PAIRS.items()})
    messages = explode_messages(chats).repartition(5, "text")
    want = {name: pair for name, (_, pair) in PAIRS.items() if pair}
    for found in (training.prompt_pairs(chats), training.prompt_pairs_of_messages(messages)):
        assert {r.dataset_id: (r.prompt, r.expected) for r in found.collect()} == want


def test_context_in_both_shapes(chats_of):
    chats = chats_of({name: [conv] for name, (conv, _) in PAIRS.items()})
    want = set()
    for name, (conv, _) in PAIRS.items():
        end = next((i for i, (r, _) in enumerate(conv) if r == A), len(conv))
        want |= {(name, 0, i, r, c) for i, (r, c) in enumerate(conv[:end])}
    nested = explode_messages(chats.withColumn("messages", C.generation_context(F.col("messages"))))
    exploded = training.context_before_answer(explode_messages(chats))
    for found in (nested, exploded):
        assert {tuple(r) for r in found.collect()} == want


def test_system_prompt_in_both_shapes(chats_of):
    data = {"d": [[(U, "a"), (A, "b")], [(S, "x"), (U, "a"), (A, "b")], [(U, "a"), (A, "b"), (S, "late")]]}
    chats = chats_of(data)
    want = {
        ("d", 0): [(S, "Be kind."), (U, "a"), (A, "b")],
        ("d", 1): data["d"][1],
        ("d", 2): data["d"][2],
    }
    nested = rewrite.add_system_prompt(chats, "  Be kind. \n")
    assert as_lists(nested) == want
    assert tuple(rewrite.modified_counts(nested).first()) == ("d", 3, 1)
    rows = rewrite.add_system_prompt_rows(explode_messages(chats), "Be kind.")
    assert as_lists(nest_messages(rows)) == want
    again = rewrite.add_system_prompt(nested.drop("modified"), "Other")
    assert as_lists(again) == want and again.where("modified").count() == 0
    assert as_lists(nest_messages(rewrite.add_system_prompt_rows(rows, "Other"))) == want
    with pytest.raises(ValueError, match="System prompt cannot be empty"):
        rewrite.add_system_prompt(chats, " \n")


def test_system_prompt_keeps_extra_keys(spark):
    entry = {"id": 7, "messages": [{"role": U, "content": "a", "name": "n"}, {"role": A, "content": "b"}], "tags": [1, {"k": None}]}
    df = spark.createDataFrame([(json.dumps(entry),)], "line string").select(
        F.lit("d").alias("dataset_id"), F.lit(1).alias("conv_id"),
        F.expr("from_json(line, 'messages array<struct<role:string,content:string>>').messages").alias("messages"),
        F.parse_json("line").alias("raw"),
    )
    row = rewrite.add_system_prompt(df, "p").withColumn("raw", F.to_json("raw")).first()
    assert json.loads(row.raw) == {**entry, "messages": [{"role": S, "content": "p"}, *entry["messages"]]}
    assert [tuple(m) for m in row.messages][0] == (S, "p")


def test_render(chats_of):
    chats = chats_of({"d": [[(S, "s"), (U, "a|b"), (A, "c")]]})
    template = {S: ("[", "]"), U: ("<", ">"), A: ("{", "}")}
    assert training.render_chats(chats, template).first().text == "[s]<a|b>{c}"


@pytest.mark.parametrize("limit", [0, 1, 5, 1500])
def test_pages(spark, limit):
    rows = [(d, i) for d, n in [("a", 3), ("b", 2000), ("c", 1)] for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "dataset_id string, conv_id bigint").repartition(6)
    got = {}
    for r in training.sample_page(df, limit).collect():
        got.setdefault(r.dataset_id, {})[r.row_no] = r.conv_id
    want = {d: {i + 1: i for i in range(min(n, limit))} for d, n in [("a", 3), ("b", 2000), ("c", 1)]}
    assert got == {d: page for d, page in want.items() if page}
    totals = {r.dataset_id: (r.total_rows, r.returned_rows) for r in training.page_totals(df, limit).collect()}
    assert totals == {"a": (3, min(3, limit)), "b": (2000, min(2000, limit)), "c": (1, min(1, limit))}


def test_negative_limit_is_refused(spark):
    df = spark.createDataFrame([("a", 1)], "dataset_id string, conv_id bigint")
    for refused in (training.sample_page, training.page_totals):
        with pytest.raises(ValueError, match="negative"):
            refused(df, -1)


def test_first_rows_split_a_hot_group_above_the_pruned_limit(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 5003).alias("k"))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        got = [(r.rank, r.k) for r in first_rows(df, ["g"], ["k"], 50).orderBy("rank").collect()]
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    keys = sorted(i * 7919 % 5003 for i in range(5000))
    assert got == list(enumerate(keys[:50], 1))


def test_rows_at_quarters(spark):
    rng = random.Random(3)
    groups = {f"n{n}": list(range(n)) for n in (1, 2, 3, 4, 5, 8, 51)}
    groups["sparse"] = sorted({rng.randrange(-(2**62), 2**62) for _ in range(333)})
    groups["clustered"] = [*range(100), *range(10**15, 10**15 + 300), 2**62]
    rows = [(g, k) for g, keys in groups.items() for k in keys]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k bigint").repartition(5)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for n_parts in (parts, "1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", n_parts)
        got = {}
        for r in rows_at_quarters(df, "g", "k").collect():
            got.setdefault(r.g, {})[r.sample_no] = (r.position, r.k)
        for g, keys in groups.items():
            n = len(keys)
            at = [0, n // 4, n // 2, 3 * n // 4, n - 1]
            assert got[g] == {i: (p, keys[p]) for i, p in enumerate(at, 1)}, (g, n_parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_one_far_key_does_not_fill_a_range(spark):
    keys = spark.range(300_000).selectExpr("'d' AS g", "id AS k").unionByName(spark.sql("SELECT 'd' AS g, 1000000000000 AS k"))
    parted = keys.repartitionByRange(4, "g", "k").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in parted.collect()) < 150_000
    got = {r.sample_no: r.k for r in rows_at_quarters(keys, "g", "k").collect()}
    assert got == {1: 0, 2: 75_000, 3: 150_000, 4: 225_000, 5: 10**12}


def test_containment(spark):
    pairs = spark.createDataFrame(
        [("d", 1, "q", " Paris "), ("d", 2, "q", "Rome"), ("d", 3, "q", None), ("d", 4, "q", ""), ("d", 5, "q", "x"), ("d", 6, "q", " ")],
        "dataset_id string, conv_id bigint, prompt string, expected string",
    )
    replies = spark.createDataFrame(
        [("d", 1, "It is PARIS."), ("d", 2, "Milan"), ("d", 3, "a"), ("d", 4, "b"), ("d", 6, "")],
        "dataset_id string, conv_id bigint, response string",
    )
    row = training.containment_accuracy(pairs, replies).first()
    assert (row.total, row.correct, row.accuracy_pct) == (6, 2, 33.3)


def test_first_system_prompt(chats_of):
    data = {
        "yes": [[(S, "first"), (U, "a"), (A, "b")], [(S, "second"), (U, "a"), (A, "b")]],
        "later": [[(U, "a"), (S, "x"), (A, "b")], [(S, "second"), (U, "a"), (A, "b")]],
    }
    got = training.first_system_prompt(explode_messages(chats_of(data)))
    assert {r.dataset_id: r.system_prompt for r in got.collect()} == {"yes": "first", "later": None}


def test_column_validation(spark):
    rows = [
        (1, 0, U, "a"), (1, 1, A, "b"),
        (2, 0, "bot", "a"),
        (3, 0, U, "a"), (3, 1, "bot", " "), (3, 2, A, None),
        (4, 0, U, "a"), (4, 1, A, None),
        (5, 0, None, "a"), (5, 1, A, "b"),
        (6, 0, U, "　"), (6, 1, "x", "b"),
        (7, 0, U, "a"), (7, 1, U, "b"),
        (8, 0, S, "a"), (8, 1, A, "b"),
    ]
    df = spark.createDataFrame([("d", *r) for r in rows], "dataset_id string, conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.error_code, r.msg_idx, r.message) for r in validate_messages(df.repartition(4)).collect()}
    assert got == {
        1: (None, None, None),
        2: ("too_few_messages", None, "Line 2: need at least 2 messages (user + assistant)"),
        3: ("role", 2, "Line 3, message 2: invalid role 'bot'. Must be: system, user, or assistant"),
        4: ("content_type", 2, "Line 4, message 2: 'content' must be a string"),
        5: ("role", 1, "Line 5, message 1: invalid role 'None'. Must be: system, user, or assistant"),
        6: ("content_empty", 1, "Line 6, message 1: 'content' cannot be empty"),
        7: ("no_assistant", None, "Line 7: conversation must have at least one 'assistant' message"),
        8: ("no_user", None, "Line 8: conversation must have at least one 'user' message"),
    }


def test_scratch_tables_go_with_their_scope(spark, tmp_path):
    import os
    import threading

    from parley.session import scratch_scope, shared_dir, written_once

    def there(purpose):
        return [name for name in os.listdir(shared_dir(spark)) if name.startswith(purpose)]

    df = spark.range(5)
    with scratch_scope(spark):
        outer = written_once(df, "outer-one")
        with scratch_scope(spark):
            written_once(outer, "inner-one").write.parquet(str(tmp_path / "kept"))
            assert len(there("inner-one")) == 1
            # Another thread is in no scope.
            thread = threading.Thread(target=lambda: written_once(df, "elsewhere"))
            thread.start()
            thread.join()
        assert there("inner-one") == [] and outer.count() == 5
    assert there("outer-one") == [] and len(there("elsewhere")) == 1
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 5
    try:
        with scratch_scope(spark):
            written_once(df, "failed-one")
            raise RuntimeError("lost")
    except RuntimeError:
        assert there("failed-one") == []
