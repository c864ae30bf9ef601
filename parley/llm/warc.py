"""WARC archives: written with an index of byte ranges, read through it."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import picked
from parley.session import scratch_path, written_once

INDEX = (
    "file string, offset bigint, length bigint, url string, digest string, "
    "page_id bigint, record_type string, refers_to bigint"
)
RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, payload string"
)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder all executors share, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", uri))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    """Line ends and other control characters can't stand in a header."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def number(value) -> int | None:
    return None if value is None or pd.isna(value) else int(value)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record: ``response`` with its payload, or ``revisit`` with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines += [f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"Refers-To-Page-ID: {refers_to}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> dict:
    """The fields of one record; raises if the payload does not have the length and digest it claims."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record of {fields.get('WARC-Target-URI')}: payload and header differ")
    return {
        "page_id": number(fields.get("Page-ID")),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("Refers-To-Page-ID")),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload.decode() if whole else None,
    }


STRETCH, TASK_BYTES = 8 << 20, 16 << 20


def with_first(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Add ``refers_to``: the smallest page id of an equal payload, null for that page itself.

    Only ids and digests are grouped. The pages themselves are joined on their id, so a payload that a
    third of all pages share fills no task; Spark broadcasts the revisits where they are few.
    """
    narrow = pages.where(F.octet_length("html") >= least_bytes).select("page_id", "sha")
    first = narrow.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = narrow.join(first, "sha").where("first is not null and not (page_id <=> first)")
    again = written_once(again.select("page_id", "sha", F.col("first").alias("refers_to")).distinct(), "revisits")
    again = again.select(F.col("page_id").alias("id"), F.col("sha").alias("key"), "refers_to")
    same = pages["page_id"].eqNullSafe(again["id"]) & (pages["sha"] == again["key"])
    # Ids travel as text: pandas would turn whole numbers beside a null into floats.
    ids = [F.col(c).cast("string") for c in ("page_id", "refers_to")]
    return pages.join(again, same, "left").select(ids[0], "url", "html", ids[1])


def write_archives(
    pages: DataFrame,
    folder: str,
    least_bytes: int = 0,
    file_bytes: int = 256 << 20,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Write a record per page below ``folder`` and return the index, itself written there.

    Every task writes archives of its own names, each record a gzip member, and hands on where each
    record lies. The index is committed by Spark, so a file of a lost or repeated attempt is in no index
    row and is never read. Among equal payloads of at least ``least_bytes`` the smallest page id is the
    response and the others are revisits; rows that repeat that id are responses too. A null html is an
    empty payload; a null url has no target header; a null id is larger than every other; an empty table
    leaves an empty index.
    """
    source = picked(pages, page_id=id_col, url=url_col, html=html_col)
    source = source.withColumn("page_id", F.col("page_id").cast("bigint"))
    source = source.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha", F.sha1("html"))
    archives = f"{folder}/archives"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = opened(archives)
        files.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to in batch.itertuples(index=False):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                    payload, page_id, refers_to = html.encode(), number(page_id), number(refers_to)
                    digest = base32_sha1(payload)
                    record = record_bytes(page_id, url, payload, digest, refers_to, date)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    packed = packer.compress(record) + packer.flush()
                    out.write(packed)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((name, at, len(packed), url, digest, page_id, kind, refers_to))
                    at += len(packed)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")]).astype(
                    {"page_id": "Int64", "refers_to": "Int64"}
                )
        finally:
            if out is not None:
                out.close()

    index = with_first(source, least_bytes).mapInPandas(write, INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(
    index: DataFrame, folder: str, payloads: bool = True, gap: int = 64 << 10, most: int = 8 << 20
) -> DataFrame:
    """The records of the given index rows (any selection of them).

    Rows are sorted by file and offset; ranges of a file less than ``gap`` bytes apart are read as one,
    up to ``most`` bytes. Files are dealt out in stretches, over as many tasks as the bytes of the records
    call for: the index itself is small, and its size says nothing about the work.
    """
    archives = f"{folder}/archives"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = opened(archives)
        for batch in batches:
            found, group = [], []

            def fetch(group, found):
                if group:
                    name, start = group[0][:2]
                    with files.open_input_file(f"{path}/{name}") as file:
                        file.seek(start)
                        data = file.read(group[-1][1] + group[-1][2] - start)
                    for _, offset, length in group:
                        found.append(parsed(zlib.decompress(data[offset - start : offset - start + length], 31)))

            for name, offset, length in batch[["file", "offset", "length"]].itertuples(index=False):
                if group and (
                    name != group[0][0]
                    or offset - (group[-1][1] + group[-1][2]) > gap
                    or offset + length - group[0][1] > most
                ):
                    fetch(group, found)
                    group = []
                group.append((name, offset, length))
            fetch(group, found)
            out = pd.DataFrame(found, columns=[c.split()[0] for c in RECORD.split(", ")])
            out = out.astype({"page_id": "Int64", "refers_to": "Int64"})
            if not payloads:
                out["payload"] = None
            yield out

    total = index.agg(F.sum("length")).first()[0] or 0
    stretch = F.call_function("div", F.col("offset"), F.lit(STRETCH))
    ranges = index.select("file", "offset", "length").repartition(1 + total // TASK_BYTES, "file", stretch)
    return ranges.sortWithinPartitions("file", "offset").mapInPandas(read, RECORD)


def archive_roundtrip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages into the shared folder and read every record back."""
    folder = scratch_path(spark, "warc")
    index = write_archives(pages, folder, least_bytes)
    return read_records(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
