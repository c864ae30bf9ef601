"""Running results over files that come in batches: nothing that was read once is read again.

Every batch leaves small partial results below one folder: sums of the statistics, the first errors, the
lines of each file, and the first place of every conversation that no earlier one equals. Partial
results merge in any order, so the results are those of one batch over all files, however and in whatever
order the files came, and after any restart.

A batch counts from the moment its commit is written, a single small file; before that its folders are
invisible, and a batch that is tried again overwrites them. From time to time a commit also covers a merged
copy of all partial results so far, so that readers open few files.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import conversation as C
from parley.functions.lines import judge_lines, line_message, lines_where
from parley.operators.features import chat_features, message_facts
from parley.operators.first import first_rows
from parley.operators.shape import explode_messages
from parley.operators.sketches import merged_sketches, response_flags, response_sketch
from parley.operators.stats import SUMS, ingest_sums, merged_sums, stats_of_sums
from parley.operators.validate import error_summary, gate_of
from parley.schema import ERRORS_SHOWN
from parley.session import scratch_scope, written_once
from parley.sources.jsonl import SUFFIX, dataset_of, file_offsets, file_rejects, list_files, read_blocks

PLACE = ["path", "at"]
MESSAGES = "ARRAY<STRUCT<role: STRING, content: STRING>>"
_ERROR = "error_code STRING, msg_idx INT, detail STRING, body STRING"


class Partial(NamedTuple):
    """A kind of partial result: its columns, and how rows of several batches become those of one."""

    schema: str
    merge: Callable[[DataFrame], DataFrame]


def _first_errors(rows: DataFrame) -> DataFrame:
    """The first errors of each dataset, files taken in path order: a few rows each."""
    return first_rows(rows, ["dataset_id"], PLACE, ERRORS_SHOWN).drop("rank")


def _first_places(rows: DataFrame) -> DataFrame:
    """The first place of each conversation, combined in each task, so that copies never meet."""
    least = rows.groupBy("dataset_id", "content_fingerprint").agg(F.min(F.struct(*PLACE)).alias("first"))
    return least.select("dataset_id", "content_fingerprint", "first.*")


PARTIALS = {
    "files": Partial("dataset_id STRING, path STRING, n BIGINT, seen BIGINT, length BIGINT", lambda rows: rows),
    "sums": Partial(f"dataset_id STRING, {', '.join(f'{c} BIGINT' for c in (*SUMS, 'n_errors'))}", lambda rows: merged_sums(rows, "n_errors")),
    "errors": Partial(f"dataset_id STRING, path STRING, at BIGINT, {_ERROR}", _first_errors),
    "responses": Partial("dataset_id STRING, response_hash BINARY, non_ascii BOOLEAN", merged_sketches),
    "firsts": Partial("dataset_id STRING, content_fingerprint STRING, path STRING, at BIGINT", _first_places),
}
_TABLES = {
    "chats": f"dataset_id STRING, path STRING, at BIGINT, messages {MESSAGES}, raw VARIANT",
    "rejects": f"dataset_id STRING, path STRING, at BIGINT, {_ERROR}",
    "refused": "dataset_id STRING, line_no BIGINT, error_code STRING, msg_idx INT, detail STRING, message STRING",
    "summary": None,
}


class RunningResults:
    """The results of all batches that were committed below ``out``.

    ``compact_every`` batches the partial results are merged. One writer at a time.
    """

    def __init__(self, spark: SparkSession, out: str, compact_every: int = 20):
        self.spark, self.out, self.compact_every = spark, out, compact_every

    # ---- commits --------------------------------------------------------------------------------

    def committed(self) -> tuple[int, int]:
        """The last batch and the last one whose partial results were merged; -1 where there is none."""
        try:
            commits = self.spark.read.schema("merged BOOLEAN, batch_id BIGINT").parquet(f"{self.out}/commits")
            row = commits.agg(F.max("batch_id").alias("last"), F.max(F.when(F.col("merged"), F.col("batch_id"))).alias("merged")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1, -1
        return (-1 if row["last"] is None else row["last"]), (-1 if row["merged"] is None else row["merged"])

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.out}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def partial(self, name: str, upto: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """Partial results of all committed batches, merged; ``only`` names the datasets to look at.

        ``upto`` also takes a batch that is being written.
        """
        kind = PARTIALS[name]
        last, merged = self.committed()
        last = last if upto is None else upto
        rows = self._read(name, f"{kind.schema}, level INT, batch_id BIGINT")
        if rows is None:
            return self.spark.createDataFrame([], kind.schema)
        single = (F.col("level") == 0) & (F.col("batch_id") > merged) & (F.col("batch_id") <= last)
        rows = rows.where(single | ((F.col("level") == 1) & (F.col("batch_id") == merged))).drop("level", "batch_id")
        if only is not None:
            rows = rows.join(only, "dataset_id", "left_semi")
        return kind.merge(rows)

    def table(self, name: str) -> DataFrame:
        last, _ = self.committed()
        rows = self._read(name, f"{_TABLES[name]}, batch_id BIGINT")
        if rows is None:
            return self.spark.createDataFrame([], _TABLES[name])
        return rows.where(F.col("batch_id") <= last).drop("batch_id")

    # ---- one batch ------------------------------------------------------------------------------

    def absorb(self, batch_id: int, lines: DataFrame, files: DataFrame, refused: DataFrame | None = None) -> None:
        """Take in a batch: ``lines(dataset_id, path, at, line)`` and ``files(dataset_id, path, n, seen, length)``.

        A batch that was committed before is left as it is. The lines are parsed once, into a written
        table; all partial results come from that. Scratch tables go when the batch is committed.
        """
        if batch_id > self.committed()[0]:
            with scratch_scope(self.spark):
                self._absorb(batch_id, lines, files, refused)

    def _absorb(self, batch_id: int, lines: DataFrame, files: DataFrame, refused: DataFrame | None) -> None:
        judged = written_once(judge_lines(lines).drop("line"), "judged-lines")
        valid = lines_where(judged, F.col("error_code").isNull())
        broken = lines_where(judged, F.col("error_code").isNotNull())
        self._write("chats", batch_id, valid.select("dataset_id", *PLACE, "messages", "raw"))
        self._write("rejects", batch_id, broken.select("dataset_id", *PLACE, "error_code", "msg_idx", "detail", "body"))
        if refused is not None:
            self._write("refused", batch_id, refused)
        # Sums and fingerprints read the messages again, from the narrow part of the written table.
        messages = valid.select("dataset_id", F.col("at").alias("conv_id"), "messages")
        sums = ingest_sums(chat_features(messages)).withColumn("n_errors", F.lit(0).cast("bigint"))
        errors = broken.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_errors"))
        zeros = {name: F.lit(0).cast("bigint") for name in SUMS}
        marked = valid.select("dataset_id", C.content_fingerprint(F.col("messages")).alias("content_fingerprint"), *PLACE)
        parts = {
            "files": files,
            "sums": merged_sums(sums.unionByName(errors.withColumns(zeros)), "n_errors"),
            "errors": _first_errors(broken),
            "responses": response_sketch(message_facts(explode_messages(messages))),
            "firsts": self._earlier_ones(_first_places(marked)),
        }
        for name, rows in parts.items():
            columns = [f.split()[0] for f in PARTIALS[name].schema.split(", ")]
            self._write(f"{name}/level=0", batch_id, rows.select(*columns))
        touched = written_once(files.select("dataset_id").distinct(), "touched")
        self._write("summary", batch_id, self.summary(batch_id, touched))
        merged = batch_id - max(self.committed()[1], -1) >= self.compact_every
        if merged:
            for name in PARTIALS:
                self._write(f"{name}/level=1", batch_id, self.partial(name, batch_id))
        commit = self.spark.range(1).select(F.lit(merged).alias("merged")).coalesce(1)
        self._write("commits", batch_id, commit)

    def _write(self, name: str, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.out}/{name}/batch_id={batch_id}")

    def _earlier_ones(self, mine: DataFrame) -> DataFrame:
        """First places of a batch that the index does not have, or has only at a later place."""
        mine = written_once(mine, "first-places")
        known = self.partial("firsts")
        known = known.toDF(*[f"known_{c}" for c in known.columns])
        same = (known["known_dataset_id"].eqNullSafe(mine["dataset_id"])) & (
            known["known_content_fingerprint"] == mine["content_fingerprint"]
        )
        before = F.struct("known_path", "known_at") <= F.struct(*PLACE)
        return mine.join(known, same & before, "left_anti")

    # ---- results --------------------------------------------------------------------------------

    def statistics(self, upto: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The statistics of each dataset's valid conversations so far, as of one batch over all files."""
        return stats_of_sums(self.partial("sums", upto, only).where("total_examples > 0").drop("n_errors"))

    def gate(self, strict: bool = True, upto: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """The verdict on each dataset so far, with its first errors, numbered through all its files."""
        counts = self.partial("sums", upto, only).select("dataset_id", F.col("total_examples").alias("n_valid"), "n_errors")
        if not strict:
            return gate_of(counts, None)
        errors = written_once(self.partial("errors", upto, only), "first-errors")
        files = self.partial("files", upto, errors.select("dataset_id").distinct())
        return gate_of(counts, error_summary(self._told(errors, file_offsets(files)), "line_no"))

    def response_flags(self) -> DataFrame:
        """Whether answers look like classes, and like several languages, from sketches of all batches.

        Conversations are read again only of datasets whose sketch leaves it open.
        """
        return response_flags(self.partial("responses"), message_facts(explode_messages(self.chats())))

    def summary(self, upto: int, only: DataFrame) -> DataFrame:
        """Verdict and statistics, a row per dataset."""
        return self.gate(True, upto, only).join(self.statistics(upto, only), "dataset_id", "left")

    def summaries(self) -> DataFrame:
        """What was told with each batch: ``batch_id`` and, of the datasets it touched, verdict and statistics."""
        return self.spark.read.parquet(f"{self.out}/summary").where(F.col("batch_id") <= self.committed()[0])

    def chats(self) -> DataFrame:
        """All valid conversations; the number of the line in its dataset is the conversation id."""
        rows = self._numbered(self.table("chats"))
        return rows.select("dataset_id", F.col("line_no").alias("conv_id"), "line_no", "messages", "raw")

    def rejects(self) -> DataFrame:
        offsets = written_once(file_offsets(self.partial("files")), "file-offsets")
        told = self._told(self.table("rejects"), offsets)
        columns = ["dataset_id", "line_no", "error_code", "msg_idx", "detail", "message"]
        return told.select(*columns).unionByName(self.table("refused").select(*columns))

    def kept(self) -> DataFrame:
        """:meth:`chats` without copies: of conversations that are equal in full the first by line number."""
        firsts = self.partial("firsts").select("dataset_id", *PLACE)
        rows = self._numbered(self.table("chats").join(firsts, ["dataset_id", *PLACE], "left_semi"))
        return rows.select("dataset_id", F.col("line_no").alias("conv_id"), "line_no", "messages", "raw")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        offsets = written_once(file_offsets(self.partial("files")), "file-offsets")
        return rows.join(offsets.drop("dataset_id"), "path").withColumn("line_no", F.col("base") + F.col("at"))

    @staticmethod
    def _told(errors: DataFrame, offsets: DataFrame) -> DataFrame:
        rows = errors.join(offsets.drop("dataset_id"), "path").withColumn("line_no", F.col("base") + F.col("at"))
        return rows.withColumn("message", line_message(F.col("line_no"), F.col("msg_idx"), F.col("body")))


def ingest_new_files(
    spark: SparkSession,
    path: str,
    out: str,
    by: str = "name",
    suffix: str = SUFFIX,
    max_bytes: int | None = None,
    compact_every: int = 20,
) -> RunningResults:
    """Read the files below ``path`` that ``out`` has not taken in yet, of any size, as one more batch.

    Files are told apart by path and are not expected to change: one of another length raises an error.
    A refused file is told once. Without a new file nothing is read or written.
    """
    results = RunningResults(spark, out, compact_every)
    listed = written_once(list_files(spark, path, by), "listed-files")
    known = results.partial("files").select("path", F.col("length").alias("was"))
    changed = listed.join(known, "path").where("length <> was").select("path").limit(3).collect()
    if changed:
        raise ValueError(f"files that were taken in before have changed: {', '.join(r.path for r in changed)}")
    new = written_once(listed.join(known, "path", "left_anti"), "new-files")
    if not new.isEmpty():
        absorb_files(results, results.committed()[0] + 1, new, by, suffix, max_bytes)
    return results


def absorb_files(
    results: RunningResults,
    batch_id: int,
    new: DataFrame,
    by: str = "name",
    suffix: str = SUFFIX,
    max_bytes: int | None = None,
) -> None:
    """Take in the listed files ``new(dataset_id, path, file_name, length)``, of any size, as one batch.

    They are read in splits, so no task holds a file. A batch that was committed before is left as it is.
    """
    if batch_id <= results.committed()[0]:
        return
    spark = results.spark
    with scratch_scope(spark):
        new = written_once(new, "batch-files")
        refused = file_rejects(new, max_bytes, suffix)
        good = F.endswith(F.lower("file_name"), F.lit(suffix))
        good = good if max_bytes is None else good & (F.col("length") <= max_bytes)
        # The reader takes a list of the new files, of which the driver holds the listing anyway.
        paths = [_as_path(r.where) for r in new.where(good).select(dataset_of(F.col("path"), "path").alias("where")).collect()]
        sizes = new.select("dataset_id", "path", "length")
        if paths:
            read = read_blocks(spark, paths, suffix)
            lines = read.placed(read.blocks).withColumn("dataset_id", dataset_of(F.col("path"), by))
            # Refused and empty files have no lines; they count as taken in all the same.
            files = sizes.join(read.files, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        else:
            lines = spark.createDataFrame([], "dataset_id STRING, path STRING, at BIGINT, line STRING")
            none = F.lit(None).cast("bigint")
            files = sizes.select("dataset_id", "path", F.lit(0).cast("bigint").alias("n"), none.alias("seen"), "length")
        results.absorb(batch_id, lines, files, refused)


def _as_path(name: str) -> str:
    """A file name as a reader's path, in which some characters stand for others."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)
