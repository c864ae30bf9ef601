"""JSONL files as chat tables.

Two scans give the same rows; both split at every Unicode line boundary:

``read_jsonl``
    one file per row, so a file must fit one. ``max_bytes`` refuses larger files, with a reject row each
    (the size filter is pushed to the reader, their content is never opened). No cap is set by default.
``scan_jsonl``
    splittable, for files of any size.

A file is a dataset, or a part of one. ``by`` says what its ``dataset_id`` is: the file's ``name``, its
whole ``path``, or the value of a ``dataset_id=`` folder above it (``partition``), as the exporter
writes them. Both number the lines of all parts of a dataset through, in path order, so the line number
is a key within the dataset.
Lines are numbered from the first non-blank line; blank lines are skipped but keep their number.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.lines import lines_where, validate_lines
from parley.session import written_once

SUFFIX = ".jsonl"


def dataset_of(file_path: Column, by: str = "name") -> Column:
    """The dataset id of a URI-encoded file path."""
    path = F.url_decode(F.regexp_replace(file_path, r"\+", "%2B"))
    if by == "path":
        return path
    if by == "partition":
        # Partition folders are escaped once more by the writer.
        return F.url_decode(
            F.regexp_replace(F.regexp_extract(path, "/dataset_id=([^/]*)/", 1), r"\+", "%2B")
        )
    if by == "name":
        return F.substring_index(path, "/", -1)
    raise ValueError(f"unknown dataset naming: {by}")


def _suffix_glob(suffix: str) -> str:
    """A file glob for a suffix in any case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _open(spark: SparkSession, path: str | list[str], source: str, suffix: str | None = None) -> DataFrame:
    reader = spark.read.format(source).option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", _suffix_glob(suffix))
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"File not found: {path}") from error
        raise


def list_files(spark: SparkSession, path: str, by: str = "name") -> DataFrame:
    """``dataset_id, file_name, path, length`` of every file; only the listing is read, no content."""
    file_path = F.col("_metadata.file_path")
    return _open(spark, path, "binaryFile").select(
        dataset_of(file_path, by).alias("dataset_id"),
        dataset_of(file_path).alias("file_name"),
        file_path.alias("path"),
        "length",
    )


def file_rejects(
    files: DataFrame, max_bytes: int | None = None, suffix: str = SUFFIX
) -> DataFrame:
    """Files refused as a whole: wrong extension or too large."""
    found = F.lower(F.regexp_extract("file_name", r"^.+(\.[^.]+)$", 1))
    wrong = found != suffix
    large = F.col("length") > max_bytes if max_bytes is not None else F.lit(False)
    code = F.when(wrong, "extension").when(large, "too_large")
    # Texts of the file-level errors.
    message = F.when(
        wrong, F.format_string("Unsupported format: %s. Please upload a .jsonl file.", found)
    ).otherwise(f"File too large. Maximum size: {(max_bytes or 0) // (1024 * 1024)}MB")
    return (
        files.withColumn("error_code", code)
        .where(F.col("error_code").isNotNull())
        .select(
            "dataset_id",
            F.lit(0).cast("bigint").alias("line_no"),
            "error_code",
            F.lit(None).cast("int").alias("msg_idx"),
            F.lit(None).cast("string").alias("detail"),
            message.alias("message"),
        )
    )


def decode(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else Latin-1; one leading byte order mark is dropped."""
    as_text = content.cast("string")
    decoded = F.when(F.is_valid_utf8(as_text), as_text).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    marked = F.startswith(decoded, F.lit(T.BYTE_ORDER_MARK))
    return F.when(marked, F.substring(decoded, 2, 2**31 - 1)).otherwise(decoded)


def split_files(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``dataset_id, line_no, line`` (and ``keep``) from a table with ``dataset_id, content``. No shuffle.

    Lines are numbered in each file by itself.
    """
    whole = T.lstrip(decode(F.col("content")))
    lines = files.select("dataset_id", *keep, F.posexplode(T.split_lines(whole)).alias("at", "line"))
    return lines.select(
        "dataset_id",
        *keep,
        (F.col("at") + 1).cast("bigint").alias("line_no"),
        T.strip_line(F.col("line")).alias("line"),
    ).where(F.col("line") != "")


def file_lines(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and line counts of whole files, a table ``path, content``.

    Lines are ``path, at, line``, where ``at`` is the place in the file, from 0, blank lines included.
    Counts are ``path, n, seen``: the lines of a file, and the place of its first non-blank one.
    """
    parts = files.select("path", T.split_lines(decode(F.col("content"))).alias("lines"))
    seen = F.array_position(F.transform("lines", lambda x: ~T.is_blank(x)), True) - 1
    # What follows the last line end of a file is a line only if there is something.
    n = F.size("lines") - (F.element_at("lines", -1) == "").cast("int")
    counts = parts.select("path", n.cast("bigint").alias("n"), F.when(seen >= 0, seen).alias("seen"))
    lines = parts.select("path", F.posexplode("lines").alias("at", "raw_line"))
    lines = lines.select("path", F.col("at").cast("bigint").alias("at"), T.strip_line(F.col("raw_line")).alias("line"))
    return lines.where(F.col("line") != ""), counts


def file_offsets(counts: DataFrame) -> DataFrame:
    """``dataset_id, path, base``: the number of a line in its dataset is ``base + at``.

    Running sums over the files of a dataset (``dataset_id, path, n, seen``) in path order number its
    lines through, from the first one that is not blank.
    """
    of_dataset = Window.partitionBy("dataset_id")
    before = of_dataset.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    leading = F.min(F.col("offset") + F.col("seen")).over(of_dataset)
    return offsets.select("dataset_id", "path", (F.col("offset") - leading + 1).alias("base"))


def read_lines(
    spark: SparkSession,
    path: str,
    max_bytes: int | None = None,
    by: str = "name",
    suffix: str = SUFFIX,
) -> DataFrame:
    """Numbered lines of all files of the suffix, up to ``max_bytes`` where that is given.

    A first pass leaves two numbers per file, its lines and where its first non-blank one is; running
    sums over a dataset's files then number the lines through.
    """
    files = _open(spark, path, "binaryFile", suffix)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    lines, counts = file_lines(files.select(F.col("_metadata.file_path").alias("path"), "content"))
    counts = counts.withColumn("dataset_id", dataset_of(F.col("path"), by))
    # Written, so that Spark knows how small it is.
    offsets = written_once(file_offsets(counts), "file-lines")
    return lines.join(offsets, "path").select("dataset_id", (F.col("base") + F.col("at")).alias("line_no"), "line")


class Blocks(NamedTuple):
    """Files read in splits: written lines, their blocks and their files; see :func:`read_blocks`."""

    lines: DataFrame
    blocks: DataFrame
    files: DataFrame

    def placed(self, extra: DataFrame) -> DataFrame:
        """Non-blank lines by their block; ``extra`` is :attr:`blocks` with more columns, which come too."""
        value = F.col("value")
        more = [c for c in extra.columns if c not in self.blocks.columns]
        joined = self.lines.join(written_once(extra, "block-lines"), ["path", "block"])
        line = T.strip_line(F.when(F.col("utf8"), value).otherwise(_latin(value)))
        place = F.col("start") + F.col("mark")
        return joined.select("path", place.alias("at"), line.alias("line"), *more).where(F.col("line") != "")


def _latin(value: Column) -> Column:
    return F.decode(value.cast("binary"), "ISO-8859-1")


def read_blocks(spark: SparkSession, path: str | list[str], suffix: str = SUFFIX, max_bytes: int | None = None) -> Blocks:
    """Files of any size, read once, in splits, into a written table of lines with their block.

    How the files are split then no longer matters, whatever executors come, go or fail. From that
    table the lines of each block are counted, and noted is whether its bytes are valid UTF-8 and where its
    first non-blank line is. Running sums over the blocks of a file turn the place in a block into one in the
    file: ``start + mark``. (The reader itself drops a byte order mark.)

    The reader splits at newlines; other Unicode boundaries are split here, so a line that holds one is
    several rows before anything is numbered. A file that is not UTF-8 is read as Latin-1, yet where one
    of its lines happens to be valid UTF-8 beyond ASCII, that line's boundaries are those of UTF-8.
    """
    value, mark = F.col("value"), F.col("mark")
    plain = F.octet_length(value) == F.length(value)
    files = _open(spark, path, "text", suffix)
    if max_bytes is not None:
        files = files.where(F.col("_metadata.file_size") <= max_bytes)
    whole = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    # Boundaries are split on the text as it will be read; bytes that are no UTF-8 stay so in the parts.
    valid = F.is_valid_utf8(value)
    parts = F.when(valid, T.split_lines(value)).otherwise(
        F.transform(T.split_lines(_latin(value)), lambda x: F.encode(x, "ISO-8859-1").cast("string"))
    )
    some = F.when(T.has_boundary(F.when(valid, value).otherwise(_latin(value))), parts).otherwise(F.array(value))
    lines = whole.select("path", "block", F.explode(some).alias("value"))
    lines = written_once(lines.select("*", F.monotonically_increasing_id().alias("mark")), "read-lines")
    blocks = lines.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("mark").alias("first"),
        F.bool_and(F.is_valid_utf8(value)).alias("valid"),
        F.min(F.when(~T.is_blank(value), mark)).alias("seen_utf8"),
        # For ASCII lines, nearly all, both decodings are the same text.
        F.min(F.when(~F.when(plain, T.is_blank(value)).otherwise(T.is_blank(_latin(value))), mark)).alias("seen_latin"),
    )
    of_file = Window.partitionBy("path")
    before = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns(
        {
            "start": F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"),
            "utf8": F.bool_and("valid").over(of_file),
        }
    )
    seen = F.col("start") + F.when(F.col("utf8"), F.col("seen_utf8")).otherwise(F.col("seen_latin"))
    blocks = written_once(blocks.select("path", "block", "n", "start", "utf8", seen.alias("seen")), "blocks")
    files = blocks.groupBy("path").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    return Blocks(lines, blocks.select("path", "block", "start", "utf8"), files)


def scan_lines(
    spark: SparkSession,
    path: str,
    by: str = "name",
    suffix: str = SUFFIX,
    max_bytes: int | None = None,
) -> DataFrame:
    """Numbered lines of files of any size, read once and in splits; see :func:`read_blocks`.

    The block table, some hundred bytes per block, is written: Spark broadcasts it below its threshold,
    and the text is not shuffled then. Its windows hold the blocks of one file, and the files of one dataset.
    """
    read = read_blocks(spark, path, suffix, max_bytes)
    offsets = file_offsets(read.files.withColumn("dataset_id", dataset_of(F.col("path"), by)))
    lines = read.placed(read.blocks.join(offsets, "path"))
    return lines.select("dataset_id", (F.col("base") + F.col("at")).alias("line_no"), "line")


def chats_of(validated: DataFrame, *keep: str) -> DataFrame:
    """Valid lines as ``chats``; the line number is the conversation id."""
    return lines_where(validated, F.col("error_code").isNull()).select(
        "dataset_id", F.col("line_no").alias("conv_id"), "line_no", "messages", "raw", *keep
    )


def rejects_of(validated: DataFrame) -> DataFrame:
    return lines_where(validated, F.col("error_code").isNotNull()).select(
        "dataset_id", "line_no", "error_code", "msg_idx", "detail", "message"
    )


def read_jsonl(
    spark: SparkSession,
    path: str,
    max_bytes: int | None = None,
    by: str = "name",
    suffix: str = SUFFIX,
) -> tuple[DataFrame, DataFrame]:
    """``(chats, rejects)`` of the files under ``path``, including files refused as a whole."""
    validated = validate_lines(read_lines(spark, path, max_bytes, by, suffix))
    refused = file_rejects(list_files(spark, path, by), max_bytes, suffix)
    return chats_of(validated), rejects_of(validated).unionByName(refused)


def scan_jsonl(
    spark: SparkSession,
    path: str,
    by: str = "name",
    suffix: str = SUFFIX,
    max_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(chats, rejects)`` of files of any size; see :func:`scan_lines`."""
    validated = validate_lines(scan_lines(spark, path, by, suffix, max_bytes))
    refused = file_rejects(list_files(spark, path, by), max_bytes, suffix)
    return chats_of(validated), rejects_of(validated).unionByName(refused)
