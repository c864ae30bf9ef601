from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from parley.functions.lines import validate_lines
from parley.operators import dedup, running, stats, validate
from parley.operators.features import chat_features, message_facts
from parley.operators.profile import response_profile
from parley.operators.running import RunningResults, ingest_new_files
from parley.operators.shape import explode_messages
from parley.sources import jsonl
from parley.streaming import arrivals


def conversation(question, system=False):
    messages = [{"role": "user", "content": question}, {"role": "assistant", "content": "a" * (len(question) % 7 + 1)}]
    return json.dumps({"messages": ([{"role": "system", "content": "s"}] if system else []) + messages})


def lines_of(seed):
    draw = random.Random(seed)
    lines = ["", " "] * draw.randint(0, 1)
    for _ in range(draw.randint(15, 30)):
        kind = draw.random()
        lines.append(
            conversation(f"q{draw.randint(0, 25)}", kind < 0.1) if kind < 0.93 else draw.choice(["[1]", "{bad", "", '{"messages": [1, 2]}'])
        )
    return draw.choice(["\n", "\r\n"]).join(lines) + draw.choice(["", "\n"])


def put(root, name, text):
    file = root / f"dataset_id={name.split('/')[0]}" / name.split("/")[1]
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(text if isinstance(text, bytes) else text.encode())


FILES = {f"{d}/part-{k:02d}.jsonl": lines_of(100 * i + k) for i, d in enumerate(["one", "two"]) for k in range(3)}
FILES["good/part-0.jsonl"] = "\n".join(conversation(f"g{k % 40}") for k in range(60))
FILES["latin/part-0.jsonl"] = conversation("x").replace("x", "é").encode("latin-1") + b"\n[2]\n"
FILES["blank/part-0.jsonl"] = " \n\n"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def expected(spark, root):
    """One batch over all files."""
    validated = validate_lines(jsonl.scan_lines(spark, str(root), by="partition"))
    chats = jsonl.chats_of(validated)
    features = chat_features(chats)
    gates = [validate.dataset_gate(validated, "line_no", strict) for strict in (True, False)]
    kept = dedup.drop_duplicates(chats, features)
    return [rows_of(x) for x in (stats.ingest_stats(features), *gates, rejected(jsonl.rejects_of(validated)), keyed(chats), keyed(kept))]


def rejected(rejects):
    return rejects.where("line_no > 0").select("dataset_id", "line_no", "error_code", "msg_idx", "detail", "message")


def keyed(chats):
    return chats.select("dataset_id", "conv_id", "line_no", F.to_json("messages"), F.to_json("raw"))


def found(results):
    parts = (results.statistics(), results.gate(), results.gate(strict=False), rejected(results.rejects()))
    return [rows_of(x) for x in (*parts, keyed(results.chats()), keyed(results.kept()))]


@pytest.mark.parametrize("order", [1, 2])
def test_stream_equals_one_batch_in_any_order_of_arrival(spark, tmp_path, order):
    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    names = sorted(FILES, reverse=order == 2)
    random.Random(order).shuffle(names)
    half = len(names) // 2
    for k, some in enumerate((names[:half], names[half:])):
        for name in some:
            put(root, name, FILES[name])
        (root / "no.csv").write_text("x") if k == 0 else None
        # A query of its own each time: a restart.
        query = arrivals.ingest_running(
            spark, str(root), out, state, by="partition", max_files=4, compact_every=2 if order == 1 else 50
        )
        query.awaitTermination()
        results = RunningResults(spark, out)
        assert found(results) == expected(spark, root)
    flags = response_profile(message_facts(explode_messages(results.chats())))
    assert rows_of(results.response_flags()) == rows_of(flags.select("dataset_id", "looks_like_classification", "is_multilingual"))
    told = results.summaries()
    last, merged = results.committed()
    # A batch of refused files alone tells nothing.
    assert 2 <= told.select("batch_id").distinct().count() <= last + 1 and (merged > 0) == (order == 1)
    good = told.where("dataset_id = 'good'").collect()
    assert [(r.accepted, r.total_examples) for r in good] == [(True, 60)]
    assert [r.error_code for r in results.rejects().where("line_no = 0").collect()] == ["extension"]


def test_only_new_files_are_read_again(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    names = sorted(FILES)
    for name in names[1::2]:
        put(root, name, FILES[name])
    (root / "big.jsonl").write_text(conversation("x" * 50_000))

    def ingest():
        return ingest_new_files(spark, str(root), out, by="partition", max_bytes=40_000)

    first = ingest()
    assert first.committed() == (0, -1)
    for name in names[::2]:
        put(root, name, FILES[name])
    put(root, "one/odd [name]*+.jsonl", conversation("odd"))
    second = ingest()
    read = spark.read.parquet(f"{out}/files/level=0/batch_id=1")
    assert {r.dataset_id for r in read.collect()} >= {"one", "two"} and read.count() == len(names[::2]) + 1
    (root / "big.jsonl").unlink()
    assert found(second) == expected(spark, root)
    # The refused file is known and told once.
    (root / "big.jsonl").write_text(conversation("x" * 50_000))
    assert ingest().committed()[0] == 1
    assert [r.error_code for r in second.rejects().where("line_no = 0").collect()] == ["too_large"]
    put(root, names[0], FILES[names[0]] + "\nmore")
    with pytest.raises(ValueError, match="have changed"):
        ingest()


def test_a_batch_that_fails_before_its_commit_is_invisible(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "in", str(tmp_path / "out")
    put(root, "one/part-1.jsonl", FILES["one/part-01.jsonl"])
    results = ingest_new_files(spark, str(root), out, by="partition")
    before = found(results)
    put(root, "one/part-0.jsonl", FILES["one/part-00.jsonl"])
    write = RunningResults._write

    def killed(self, name, batch_id, rows):
        if name == "commits":
            raise RuntimeError("killed")
        write(self, name, batch_id, rows)

    monkeypatch.setattr(RunningResults, "_write", killed)
    with pytest.raises(RuntimeError, match="killed"):
        ingest_new_files(spark, str(root), out, by="partition")
    monkeypatch.undo()
    assert found(results) == before
    assert results.summaries().select("batch_id").distinct().count() == 1
    # Tried again, the batch is taken in once; handed in once more, it is left alone.
    ingest_new_files(spark, str(root), out, by="partition")
    assert found(results) == expected(spark, root)
    nothing = spark.createDataFrame([], "dataset_id STRING, path STRING, at BIGINT, line STRING")
    results.absorb(1, nothing, spark.createDataFrame([], running.PARTIALS["files"].schema))
    assert found(results) == expected(spark, root)


def test_nothing_yet(spark, tmp_path):
    results = RunningResults(spark, str(tmp_path / "none"))
    assert results.committed() == (-1, -1)
    assert [x for x in found(results)] == [[]] * 6


def test_rollups_have_the_row_of_the_whole(spark, chats_of):
    from parley.operators.quality import quality_score
    from parley.operators.stats import ingest_stats, stats_rollup

    talk = [("user", "u"), ("assistant", "hello")]
    sets = {"a": [talk, talk, [("system", "s"), *talk]], "b": [talk, [("user", "x"), ("assistant", "")]], "c": [talk]}
    features = chat_features(chats_of(sets))
    rows = stats_rollup(features).collect()
    assert len(rows) == 4
    whole = ingest_stats(features.withColumn("dataset_id", F.lit(None).cast("string"))).collect()[0].asDict()
    assert {k: v for k, v in [r for r in rows if r.is_overall][0].asDict().items() if k != "is_overall"} == whole
    assert sorted(tuple(r[:1]) + tuple(r[2:]) for r in rows if not r.is_overall) == sorted(map(tuple, ingest_stats(features).collect()))
    scored = {r.dataset_id: r for r in quality_score(features, overall=True).collect()}
    # One text is in all three datasets: copies of it count across them.
    assert (scored[None].duplicates, scored["a"].duplicates, scored["b"].duplicates) == (3, 1, 0)
    assert scored[None].is_overall and scored[None].n_examples == 6


def test_a_stream_reads_files_in_splits(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    put(root, "one/part-0.jsonl", "\n".join(conversation(f"q{k:06d}") for k in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        arrivals.ingest_running(spark, str(root), out, str(tmp_path / "state"), by="partition").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    read = spark.read.parquet(f"{out}/chats").groupBy(F.input_file_name()).count().collect()
    # One file of 400 KB: no task may have had all of it.
    assert sum(r["count"] for r in read) == 4000 and max(r["count"] for r in read) < 2000
    assert RunningResults(spark, out).kept().count() == 4000


def test_line_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    from parley.plans import queries

    rows = [(k, "x" * 100, "en") for k in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries._ranges(spark, str(tmp_path)) == 6
    monkeypatch.setattr(queries, "_RANGE_BYTES", 2000)
    path = queries._line_files(spark, str(tmp_path), queries._ranges(spark, str(tmp_path)))
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path")).count().collect()
    assert sum(r["count"] for r in files) == 400 and max(r["count"] for r in files) < 50
