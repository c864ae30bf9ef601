"""Writers: JSONL and training sets."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.manifest import config_json
from parley.sources.jsonl import dataset_of, scan_jsonl

# The files of a training set.
DATA_FILE, CONFIG_FILE = "data.jsonl", "config.json"


def json_lines(chats: DataFrame) -> DataFrame:
    """``dataset_id, conv_id, value``: one JSON object per conversation.

    A ``raw`` variant is written whole, so extra keys are kept; otherwise the messages alone.
    """
    if "raw" in chats.columns:
        value = F.coalesce(F.to_json("raw"), F.to_json(F.struct("messages")))
    else:
        value = F.to_json(F.struct("messages"))
    return chats.select("dataset_id", "conv_id", value.alias("value"))


def write_jsonl(chats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write all conversations as JSONL parts below ``path``, in (dataset, conversation) order.

    The rows are range-partitioned on both keys, so a large dataset is spread over many parts and
    reading the parts by name gives the lines in order.
    """
    lines = json_lines(chats).repartitionByRange("dataset_id", "conv_id")
    lines.sortWithinPartitions("dataset_id", "conv_id").select("value").write.mode(mode).text(path)


def published_exports(spark: SparkSession, path: str) -> DataFrame | None:
    """``export, published_at, n_files, n_rows`` of the exports below ``path`` that are whole; None without any."""
    schema = "export STRING, published_at TIMESTAMP, n_files BIGINT, n_rows BIGINT"
    try:
        return spark.read.schema(schema).json(f"{path}/published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _last_export(spark: SparkSession, path: str) -> str | None:
    found = published_exports(spark, path)
    row = found and found.orderBy(F.desc("published_at"), F.desc("export")).first()
    return row["export"] if row else None


def _staged_files(spark: SparkSession, folder: str) -> DataFrame:
    """``dataset_id, file, part, n_rows, n_bytes, checksum`` of what lies there, read from the files themselves."""
    file_path = F.col("_metadata.file_path")
    parts = spark.read.option("recursiveFileLookup", "true").text(folder)
    rows = parts.select(
        dataset_of(file_path, "partition").alias("dataset_id"),
        F.regexp_extract(file_path, "/file=([^/]*)/[^/]*$", 1).alias("file"),
        F.substring_index(file_path, "/", -1).alias("part"),
        "value",
    )
    return rows.groupBy("dataset_id", "file", "part").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.octet_length("value") + 1).alias("n_bytes"),
        F.sum(F.crc32(F.col("value").cast("binary"))).alias("checksum"),
    )


def export_training_sets(
    chats: DataFrame, manifests: DataFrame, path: str, mode: str = "errorifexists"
) -> str:
    """Write every dataset's JSONL parts and its manifest beside them, as one export that counts as a whole.

    One job writes ``sets/export=.../dataset_id=.../file=data.jsonl/part-*`` and ``file=config.json/part-*``; the
    manifest's ``data_path`` names the data as seen from its folder's parent. What was written is then
    read back into a list of files with their rows and checksums, and at last one small file below
    ``published`` makes the export known. Readers go by that file and the list: until it is there, nothing of
    the export is visible, and an export that was killed leaves no half set, only staged files.

    ``mode`` is ``errorifexists`` (an export was published here before) or ``overwrite`` (the new one takes
    its place as soon as it is published; readers of the old one are not disturbed). Returns the export's id.
    """
    spark = chats.sparkSession
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "errorifexists" and _last_export(spark, path):
        raise ValueError(f"there is an export at {path} already")
    export = uuid.uuid4().hex
    lines = json_lines(chats).withColumn("file", F.lit(DATA_FILE))
    own = config_json(manifests.withColumn("data_path", F.lit(f"./file={DATA_FILE}")))
    own = own.select("dataset_id", F.lit(None).cast("bigint").alias("conv_id"), F.col("config").alias("value"))
    rows = lines.unionByName(own.withColumn("file", F.lit(CONFIG_FILE)))
    order = ["dataset_id", "file", "conv_id"]
    staged = f"{path}/sets/export={export}"
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("dataset_id", "file", "value").write.partitionBy("dataset_id", "file").text(staged)
    _staged_files(spark, staged).write.parquet(f"{path}/files/export={export}")
    files = spark.read.parquet(f"{path}/files/export={export}")
    told = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
    told = told.select(F.lit(export).alias("export"), F.current_timestamp().alias("published_at"), "*")
    told.coalesce(1).write.mode("append").json(f"{path}/published")
    return export


def published_files(spark: SparkSession, path: str, export: str | None = None) -> DataFrame:
    """The list of files of an export, the last one unless told."""
    export = export or _last_export(spark, path)
    if export is None:
        raise FileNotFoundError(f"No published export: {path}")
    return spark.read.parquet(f"{path}/files/export={export}")


def data_files(path: str, export: str = "*") -> str:
    """The reader's path of the data of an export's sets."""
    return f"{path}/sets/export={export}/dataset_id=*/file={DATA_FILE}"


def read_training_sets(
    spark: SparkSession, path: str, export: str | None = None, verify: bool = True
) -> tuple[DataFrame, DataFrame]:
    """``(configs, chats)`` of a published export: ``dataset_id, config`` and the conversations, numbered through.

    With ``verify`` every file is first compared with the published rows and checksums, a pass over the text;
    a missing, foreign or altered file raises an error.
    """
    export = export or _last_export(spark, path)
    listed = published_files(spark, path, export)
    folder = f"{path}/sets/export={export}"
    if verify:
        key = ["dataset_id", "file", "part"]
        there = _staged_files(spark, folder)
        sums = ["n_rows", "n_bytes", "checksum"]
        told = listed.select(*key, F.struct(*sums).alias("told"))
        wrong = told.join(there.select(*key, F.struct(*sums).alias("there")), key, "full")
        wrong = wrong.where(~F.col("told").eqNullSafe(F.col("there"))).limit(3).collect()
        if wrong:
            raise ValueError(f"files differ from what was published: {', '.join(r.part for r in wrong)}")
    files = F.col("_metadata.file_path")
    configs = spark.read.option("recursiveFileLookup", "true").text(f"{folder}/dataset_id=*/file={CONFIG_FILE}")
    configs = configs.select(dataset_of(files, "partition").alias("dataset_id"), F.col("value").alias("config"))
    chats, _ = scan_jsonl(spark, data_files(path, export), by="partition", suffix=".txt")
    return configs, chats
