"""Structured Streaming over arriving JSONL files.

Each file is validated in the micro-batch in which it arrives, with the rules of the batch reader. Lines
are numbered in each file by itself, since the files of a dataset are not all known; so a conversation's
key is made of its file and line. The data has no event time: a file arrives when its micro-batch
starts, whatever its modification time says, and nothing is late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.functions import conversation as C
from parley.functions.lines import lines_where, validate_lines
from parley.operators.running import RunningResults, absorb_files
from parley.session import scratch_scope, written_once
from parley.sources.jsonl import (
    SUFFIX,
    chats_of,
    dataset_of,
    file_rejects,
    rejects_of,
    split_files,
)

_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def _arriving(spark: SparkSession, path: str, by: str, max_files: int | None) -> DataFrame:
    reader = (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        # The source would pass over files that are a week older than the newest one it has seen.
        .option("maxFileAge", "36500d")
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    file_path = F.col("_metadata.file_path")
    return reader.load(path).select(
        dataset_of(file_path, by).alias("dataset_id"),
        dataset_of(file_path).alias("file_name"),
        file_path.alias("file_path"),
        "length",
        F.current_timestamp().alias("arrived"),
        "content",
    )


def _acceptable(max_bytes: int | None, suffix: str) -> Column:
    right = F.endswith(F.lower("file_name"), F.lit(suffix))
    return right if max_bytes is None else right & (F.col("length") <= max_bytes)


def _file_key() -> Column:
    """A key for a line of any file: 64 bits of its path and number."""
    return F.xxhash64("file_path", "line_no")


def _keyed(chats: DataFrame) -> DataFrame:
    return chats.withColumn("conv_id", _file_key())


def ingest_stream(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    max_bytes: int | None = None,
    by: str = "name",
    suffix: str = SUFFIX,
    max_files: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Write ``out/chats`` and ``out/rejects`` from the files arriving under ``path``.

    Every micro-batch overwrites its own ``batch_id=`` folder, so a batch that is tried again does not
    append twice. Files that are refused as a whole are taken from the listing alone; the size
    filter reaches the reader, so their content is not read. ``trigger`` goes to the writer and
    defaults to ``availableNow=True``.
    """
    files = _arriving(spark, path, by, max_files)
    nothing = F.lit(None).cast("binary")
    acceptable = _acceptable(max_bytes, suffix)
    refused = files.where(~acceptable).withColumn("content", nothing)
    arriving = files.where(acceptable).unionByName(refused)

    def write(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):
            write_tables(batch, batch_id)

    def write_tables(batch: DataFrame, batch_id: int) -> None:
        lines = split_files(batch.where(F.col("content").isNotNull()), keep=("file_path",))
        # Parsed once for both outputs, in the shared folder: a lost executor loses none of it.
        validated = written_once(validate_lines(lines), "arrived-lines")
        rejects = rejects_of(validated).unionByName(
            file_rejects(batch.where(F.col("content").isNull()), max_bytes, suffix)
        )
        _keyed(chats_of(validated, "file_path")).write.mode("overwrite").parquet(f"{out}/chats/batch_id={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{out}/rejects/batch_id={batch_id}")

    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ingest_running(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    max_bytes: int | None = None,
    by: str = "name",
    suffix: str = SUFFIX,
    max_files: int | None = None,
    compact_every: int = 20,
    **trigger,
) -> StreamingQuery:
    """Files arriving under ``path`` are validated, gated, summarised and freed of copies at once.

    Each micro-batch is one batch of :class:`~parley.operators.running.RunningResults` below ``out``: after
    it, verdicts with the first errors, statistics, and the conversations left without copies are those of
    one batch over all files so far, whatever the order in which they came. What was told with each batch
    is in its ``summaries``. A batch that is tried again overwrites what it left; one that was committed is
    not taken in twice. The stream carries the listing alone: each batch reads its files in splits, so they
    may be of any size, and the content of refused files is not read.
    """
    results = RunningResults(spark, out, compact_every)
    arriving = _arriving(spark, path, by, max_files).drop("content")

    def write(batch: DataFrame, batch_id: int) -> None:
        listed = batch.select("dataset_id", F.col("file_path").alias("path"), "file_name", "length")
        absorb_files(results, batch_id, listed, by, suffix, max_bytes)

    return (
        arriving.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def chat_stream(
    spark: SparkSession,
    path: str,
    max_bytes: int | None = None,
    by: str = "name",
    suffix: str = SUFFIX,
    max_files: int | None = None,
) -> DataFrame:
    """Valid conversations of arriving files as a streaming ``chats`` table with ``file_path, arrived``.

    What is left out is in :func:`refused_stream` over the same files.
    """
    files = _arriving(spark, path, by, max_files).where(_acceptable(max_bytes, suffix))
    lines = split_files(files, keep=("file_path", "arrived"))
    valid = lines_where(validate_lines(lines), F.col("error_code").isNull())
    return _keyed(valid).select("dataset_id", "conv_id", "line_no", "messages", "raw", "file_path", "arrived")


def refused_stream(
    spark: SparkSession,
    path: str,
    max_bytes: int | None = None,
    by: str = "name",
    suffix: str = SUFFIX,
    max_files: int | None = None,
) -> DataFrame:
    """What :func:`chat_stream` leaves out: refused files and invalid lines, as a streaming table."""
    files = _arriving(spark, path, by, max_files)
    good = _acceptable(max_bytes, suffix)
    content = F.when(good, F.col("content"))
    lines = split_files(files.withColumn("content", content).where(F.col("content").isNotNull()))
    broken = rejects_of(validate_lines(lines))
    return broken.unionByName(file_rejects(files.where(~good), max_bytes, suffix))


def first_arrivals(chats: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop conversations that arrived before, the same in full, within ``delay`` of their arrival.

    The state holds one hash per conversation for that time; a conversation that comes again later is
    kept as a new one. The first to arrive is kept, which need not be the one with the lowest line number.
    """
    return (
        chats.withColumn("content_fingerprint", C.content_fingerprint(F.col("messages")))
        .withWatermark("arrived", delay)
        .dropDuplicatesWithinWatermark(["dataset_id", "content_fingerprint"])
    )
