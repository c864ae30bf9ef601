from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from parley.operators.features import message_facts
from parley.operators.profile import response_profile
from parley.operators.sketches import merged_sketches, response_flags, response_sketch, sketched_profile


def facts_of(spark, sets):
    rows = [(name, k, 1, "assistant", text) for name, texts in sets.items() for k, text in enumerate(texts)]
    rows += [(name, 0, 0, "user", "é ask") for name in sets]
    return message_facts(spark.createDataFrame(rows, "dataset_id string, conv_id bigint, turn bigint, role string, text string"))


@pytest.fixture(scope="module")
def facts(spark):
    random.seed(1)
    made = lambda n, share: [f"a {k}" + ("é" if k < share * n else "") for k in range(n) for _ in range(random.choice([1, 1, 5]))]
    sets = {"few": ["x", "y", "X ", "x"], "19": made(19, 0), "20": made(20, 1), "large": made(900, 0.1), "wide": made(900, 0.8)}
    # At the bound: no sketch can tell.
    sets |= {"near": made(1000, 0.299), "nearer": made(1000, 0.303), "copies": ["é"] * 3000 + made(300, 0)}
    return facts_of(spark, sets)


def flags(df):
    rows = df.select("dataset_id", "looks_like_classification", "is_multilingual").collect()
    return {r.dataset_id: (r.looks_like_classification, r.is_multilingual) for r in rows}


def test_flags_are_those_of_the_exact_count(facts):
    want = flags(response_profile(facts))
    assert want["19"][0] and not want["20"][0] and want["nearer"][1] and not want["near"][1] and not want["copies"][1]
    for size in (20, 64, 1000):
        assert flags(response_flags(response_sketch(facts, size), facts, size)) == want
    told = {r.dataset_id: r for r in sketched_profile(response_sketch(facts, 64), 64).collect()}
    assert told["few"].is_exact and told["few"].distinct_responses == 2
    assert not told["near"].is_sure and told["wide"].is_sure
    assert abs(told["large"].distinct_responses - 900) < 4 * 900 / 8


def test_parts_merge_to_the_whole(facts):
    parts = [facts.where(F.pmod("conv_id", F.lit(3)) == k) for k in range(3)]
    merged = response_sketch(parts[2], 64)
    for part in parts[:2]:
        merged = merged_sketches(merged.unionByName(response_sketch(part, 64)), 64)
    rows = lambda df: sorted((r.dataset_id, bytes(r.response_hash), r.non_ascii) for r in df.collect())
    assert rows(merged) == rows(response_sketch(facts, 64))


def test_no_answers_and_sketches_too_small(facts):
    assert response_flags(response_sketch(facts.where("false")), facts.where("false")).collect() == []
    with pytest.raises(ValueError):
        merged_sketches(facts, 19)
