"""Duplicate conversations: mark them, remove them.

Conversations are the same if all their messages are, from the first character to the last. The mark of
the quality score also has a wider sense, the same first 100 characters of every message: that one is
for counting, and nothing is removed by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.schema import CONV_KEY


def first_copies(features: DataFrame, by: str = "content_fingerprint") -> DataFrame:
    """Key of the first conversation of every fingerprint.

    ``min`` combines on the map side, so the copies of one text never meet in one task.
    """
    return features.groupBy("dataset_id", by).agg(F.min("conv_id").alias("conv_id")).select(*CONV_KEY)


def mark_duplicates(features: DataFrame) -> DataFrame:
    """``is_duplicate`` (by the first 100 characters of each message) and ``is_copy`` (in full).

    The firsts of both senses are one table, a row per conversation, joined once, on the unique
    conversation key and never on a fingerprint: a fingerprint with many copies causes no skew.
    ``features`` is read three times: write it first where it is costly.
    """
    senses = {"is_duplicate": "fingerprint", "is_copy": "content_fingerprint"}
    firsts = [first_copies(features, by).withColumn("_sense", F.lit(name)) for name, by in senses.items()]
    firsts = firsts[0].unionByName(firsts[1]).groupBy(*CONV_KEY)
    firsts = firsts.agg(*[F.bool_or(F.col("_sense") == name).alias(f"_{name}") for name in senses])
    marked = features.select(*CONV_KEY).join(firsts, CONV_KEY, "left")
    return marked.select(*CONV_KEY, *[(~F.coalesce(f"_{name}", F.lit(False))).alias(name) for name in senses])


def drop_duplicates(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of ``chats`` or ``messages`` whose conversation is the first of those equal to it in full."""
    return rows.join(first_copies(features), CONV_KEY, "left_semi")
