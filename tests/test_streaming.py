from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from parley.sources import jsonl
from parley.streaming import arrivals


def conversation(question):
    return json.dumps({"messages": [{"role": "user", "content": question}, {"role": "assistant", "content": "a"}]})


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_stream_equals_batch_and_retry_appends_nothing(spark, tmp_path):
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()

    def run():
        arrivals.ingest_stream(spark, str(source), str(out), str(state), max_bytes=5000, max_files=2).awaitTermination()

    for i in range(5):
        lines = [conversation(f"q{i}-{k}") for k in range(10)] + ["", "[1]", "{bad"]
        (source / f"f{i}.jsonl").write_text("\n".join(lines))
    (source / "big.jsonl").write_text(conversation("x" * 6000))
    (source / "other.csv").write_text("a")
    run()
    run()
    (source / "late.JSONL").write_text(conversation("late"))
    run()

    chats, rejects = jsonl.read_jsonl(spark, str(source), max_bytes=5000)
    key = ("dataset_id", "line_no", "messages")
    arrived = spark.read.parquet(str(out / "chats"))
    assert rows_of(arrived, *key) == rows_of(chats, *key)
    assert arrived.select("dataset_id", "conv_id").distinct().count() == arrived.count()
    key = ("dataset_id", "line_no", "error_code", "message")
    assert rows_of(spark.read.parquet(str(out / "rejects")), *key) == rows_of(rejects, *key)
    codes = {r.error_code for r in rejects.collect()}
    assert codes == {"not_object", "invalid_json", "too_large", "extension"}


def test_old_files_are_not_late_and_refused_files_are_told(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def run(stream, name):
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / name))
        query = query.option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    for k, age in enumerate((0, 0, 10 * 86_400)):
        path = source / f"f{k}.jsonl"
        head = "x" * 100
        path.write_text("\n".join(conversation(head + q) for q in ("same", f"own {k}")))
        os.utime(path, (path.stat().st_atime, path.stat().st_mtime - age))
        chats = arrivals.chat_stream(spark, str(source), by="path", max_files=1)
        chats = arrivals.first_arrivals(chats.withColumn("dataset_id", F.lit("one")))
        got = run(chats.select(F.substring(F.col("messages")[0]["content"], 101, 9).alias("q")), "first")
    assert rows_of(got, "q") == [("own 0",), ("own 1",), ("own 2",), ("same",)]
    (source / "no.csv").write_text("x")
    (source / "bad.jsonl").write_text("[1]")
    refused = run(arrivals.refused_stream(spark, str(source), max_files=1), "refused")
    assert rows_of(refused, "dataset_id", "error_code") == [("bad.jsonl", "not_object"), ("no.csv", "extension")]


def test_stream_keeps_first_arrivals(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "d.jsonl").write_text("\n".join(conversation(q) for q in ["a", "b", "a", "c", "b", "a"]))
    stream = arrivals.first_arrivals(arrivals.chat_stream(spark, str(source)))
    query = (
        stream.select("dataset_id", F.col("messages")[0]["content"].alias("q"))
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), "q") == [("a",), ("b",), ("c",)]
