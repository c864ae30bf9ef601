"""The shape of plans, and every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check_oracle import differences, duckdb_views
from parley.operators.features import conversation_features, message_facts
from parley.operators.profile import json_profile
from parley.operators.stats import ingest_stats
from parley.operators.training import prompt_pairs_of_messages
from parley.plans.inputs import conversation_messages
from parley.plans.oracle import all_oracles
from parley.plans.queries import all_queries
from parley.schema import RESPONSE_SAMPLE

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()
ORACLES = all_oracles()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def duck():
    return duckdb_views(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = plan_of(df)
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert "NestedLoop" not in plan
    assert differences(df, duck, ORACLES[name]) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.total_examples for r in rows) == 16


def test_statistics_read_once_and_shuffle_no_text(spark):
    plan = plan_of(ingest_stats(conversation_features(message_facts(conversation_messages(spark, SF)))))
    assert plan.count("FileScan") == 1
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 2
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_first_fifty_are_pruned_before_the_shuffle(spark):
    plan = plan_of(json_profile(message_facts(conversation_messages(spark, SF)), RESPONSE_SAMPLE))
    assert plan.count("WindowGroupLimit") == 2


def test_pairs_need_one_shuffle(spark):
    plan = plan_of(prompt_pairs_of_messages(conversation_messages(spark, SF)))
    assert sum("Exchange" in line for line in plan.splitlines()) == 1


def test_only_needed_columns_are_read(spark):
    plan = plan_of(
        conversation_features(message_facts(conversation_messages(spark, SF))).select("dataset_id", "n_user")
    )
    assert "ReadSchema: struct<conv_id:bigint,role:string>" in plan
