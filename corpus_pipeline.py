"""A corpus pipeline of the operators in ``parley.llm``.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the one before kept and returns the
columns of ``documents``; the last returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.bpe import bpe_roundtrip
from parley.llm.common import table
from parley.llm.leaks import leaks
from parley.llm.lines import drop_common_lines
from parley.llm.ngrams import near_duplicates
from parley.llm.quality import quality_scores
from parley.llm.queries import vocabulary
from parley.session import scratch_path, scratch_scope, written_once


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; null texts are scored as empty ones, repeated rows alike."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; of a null text an empty one is left."""
    found = drop_common_lines(docs, min_docs=10).select("row.*", "kept")
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")}
    return found.withColumns(changed).select(*docs.columns)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; documents without words stay."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
    kept = written_once(kept.distinct(), "kept")
    hashed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = hashed["doc_id"].eqNullSafe(kept["id"]) & (hashed["text_hash"] == kept["h"])
    # A repeated row is a copy too.
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark; null and empty texts contain none, repeated rows go together."""
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    found = written_once(found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).distinct(), "leaked")
    hashed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = hashed["doc_id"].eqNullSafe(found["id"]) & (hashed["text_hash"] == found["h"])
    return hashed.join(found, same, "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what is left."""
    # Less memory than alone: the executors of a pipeline hold what earlier stages left in their heap.
    return bpe_roundtrip(docs, vocabulary(), digest=True, most=150_000, together=250_000)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicate_join),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

# The classifier can't be written in SQL: tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        # What a stage writes on its way goes as soon as its result is there.
        with scratch_scope(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
