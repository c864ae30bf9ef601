"""Mergeable sketches of the distinct answers of datasets.

The sketch of a dataset is its ``k`` distinct answers with the least hashes. That is a sample of all distinct
answers, each as likely as any other however often it comes; the sketch of a whole is that of its parts'
sketches taken together; and a dataset of fewer than ``k`` distinct answers is in it in full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators.first import first_rows
from parley.operators.profile import response_profile
from parley.schema import CLASSIFICATION_MAX_DISTINCT, MULTILINGUAL_SHARE
from parley.session import written_once

SIZE = 1000
# Hash digits that make up a number below one: 15 hexadecimal ones fit a BIGINT.
_DIGITS = 15
# Shares of a sample nearer to the bound than so many standard errors are not trusted.
_ERRORS = 4


def response_sketch(facts: DataFrame, size: int = SIZE) -> DataFrame:
    """``dataset_id, response_hash, non_ascii`` from :func:`~parley.operators.features.message_facts`."""
    return merged_sketches(facts.where("is_answer").select("dataset_id", "response_hash", "non_ascii"), size)


def merged_sketches(sketches: DataFrame, size: int = SIZE) -> DataFrame:
    """Sketches of several parts, as a union, to that of the whole. Equal answers combine in each task."""
    if size < CLASSIFICATION_MAX_DISTINCT:
        raise ValueError(f"a sketch has {CLASSIFICATION_MAX_DISTINCT} answers at least")
    distinct = sketches.groupBy("dataset_id", "response_hash").agg(F.bool_or("non_ascii").alias("non_ascii"))
    return first_rows(distinct, ["dataset_id"], ["response_hash"], size).drop("rank")


def sketched_profile(sketch: DataFrame, size: int = SIZE) -> DataFrame:
    """What a sketch says about each dataset.

    ``is_exact`` where it holds all answers. Whether there are few enough for a classification is always
    exact. ``distinct_responses`` is else estimated from the greatest hash kept (standard error
    ``1 / sqrt(size)`` of it), and the multilingual share from the sample, ``is_sure`` where it lies four standard
    errors or more from the bound.
    """
    n = F.col("sampled")
    rows = sketch.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if("non_ascii").alias("wide"), F.max("response_hash").alias("last")
    )
    share = T.safe_ratio(F.col("wide"), n)
    error = math.sqrt(MULTILINGUAL_SHARE * (1 - MULTILINGUAL_SHARE) / size)
    exact = n < size
    return rows.select(
        "dataset_id",
        exact.alias("is_exact"),
        F.when(exact, n).otherwise(_estimated(F.col("last"), size)).alias("distinct_responses"),
        ((n > 0) & (n < CLASSIFICATION_MAX_DISTINCT)).alias("looks_like_classification"),
        (share > MULTILINGUAL_SHARE).alias("is_multilingual"),
        (exact | (F.abs(share - MULTILINGUAL_SHARE) >= _ERRORS * error)).alias("is_sure"),
    )


def _estimated(last: Column, size: int) -> Column:
    """How many hashes there are if the ``size``-th least of them is ``last``."""
    place = F.conv(F.substring(F.hex(last), 1, _DIGITS), 16, 10).cast("double") / float(16**_DIGITS)
    return F.round((size - 1) / place).cast("bigint")


def response_flags(sketch: DataFrame, facts: DataFrame, size: int = SIZE) -> DataFrame:
    """``dataset_id, looks_like_classification, is_multilingual`` as the exact count of all answers gives them.

    Only datasets whose share in the sketch is too near the bound are counted again, from ``facts``. For the
    others the flag is wrong with a chance below one in ten thousand; with fewer than ``size`` answers, never.
    """
    told = written_once(sketched_profile(sketch, size), "sketched-profile")
    flags = ["dataset_id", "looks_like_classification", "is_multilingual"]
    unsure = written_once(told.where(~F.col("is_sure")).select("dataset_id"), "unsure")
    again = response_profile(facts.join(unsure, "dataset_id", "left_semi"))
    return told.where("is_sure").select(*flags).unionByName(again.select(*flags))
