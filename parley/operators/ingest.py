"""Ingest as one operation: files in, conversations, rejects, verdicts and statistics out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.lines import validate_lines
from parley.operators.features import chat_features
from parley.operators.stats import ingest_stats
from parley.operators.validate import dataset_gate
from parley.session import written_once
from parley.sources.jsonl import SUFFIX, chats_of, file_rejects, list_files, rejects_of, scan_lines


class Ingested(NamedTuple):
    chats: DataFrame
    rejects: DataFrame
    gate: DataFrame
    stats: DataFrame


def ingest_jsonl(
    spark: SparkSession,
    path: str,
    by: str = "name",
    suffix: str = SUFFIX,
    strict: bool = True,
    max_bytes: int | None = None,
) -> Ingested:
    """Read all files of the suffix below ``path``, of any size, and judge every dataset.

    Every line is parsed once, into a written table that all four results read. Statistics are of the
    valid conversations of accepted and refused datasets alike; ``gate`` says which is which.
    """
    files = written_once(list_files(spark, path, by), "files")
    refused = file_rejects(files, max_bytes, suffix)
    lines = scan_lines(spark, path, by, suffix, max_bytes)
    validated = written_once(validate_lines(lines), "validated-lines")
    chats = chats_of(validated)
    rejects = rejects_of(validated).unionByName(refused)
    gate = dataset_gate(validated.select("dataset_id", "line_no", "error_code", "message"), "line_no", strict)
    stats = ingest_stats(chat_features(chats).withColumn("is_valid", F.lit(True)))
    return Ingested(chats, rejects, gate, stats)
