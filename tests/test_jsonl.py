from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from parley.functions.lines import validate_lines
from parley.operators.validate import accepted_rows, dataset_gate, error_summary
from parley.sources import jsonl, sinks

OK = '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}'
U, A = {"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}


def line(*messages, **extra):
    return json.dumps({"messages": list(messages), **extra}, ensure_ascii=False)


GOLDEN = [
    ("{bad", "invalid_json", None),
    ('{"messages": []} x', "invalid_json", None),
    (OK + "," + OK, "invalid_json", None),
    (OK + " " + OK, "invalid_json", None),
    ('{"messages": NaN}', "invalid_json", None),
    ("[1]", "not_object", ": must be a JSON object, got list"),
    ("null", "not_object", ": must be a JSON object, got NoneType"),
    ('"s"', "not_object", ": must be a JSON object, got str"),
    ("5", "not_object", ": must be a JSON object, got int"),
    ("1.5", "not_object", ": must be a JSON object, got float"),
    ("true", "not_object", ": must be a JSON object, got bool"),
    ('{"a": 1}', "no_messages", ": missing 'messages' array"),
    ('{"messages": null}', "messages_not_array", ": 'messages' must be an array"),
    ('{"messages": {"a": 1}}', "messages_not_array", ": 'messages' must be an array"),
    ('{"messages": "[]"}', "messages_not_array", ": 'messages' must be an array"),
    (line(), "too_few_messages", ": need at least 2 messages (user + assistant)"),
    (line(U), "too_few_messages", ": need at least 2 messages (user + assistant)"),
    ('{"messages": [1, 2]}', "message_not_object", ", message 1: must be an object, got int"),
    (line(U, None), "message_not_object", ", message 2: must be an object, got NoneType"),
    ('{"messages": [{"content":"a"},{}]}', "no_role", ", message 1: missing 'role' field"),
    ('{"messages": [{"role":"bot"},{}]}', "no_content", ", message 1: missing 'content' field"),
    (line({"role": "User", "content": "a"}, {}), "role",
     ", message 1: invalid role 'User'. Must be: system, user, or assistant"),
    (line({"role": None, "content": "a"}, {}), "role",
     ", message 1: invalid role 'None'. Must be: system, user, or assistant"),
    (line({"role": True, "content": "a"}, {}), "role",
     ", message 1: invalid role 'True'. Must be: system, user, or assistant"),
    (line({"role": 7, "content": "a"}, {}), "role",
     ", message 1: invalid role '7'. Must be: system, user, or assistant"),
    (line({"role": ["user"], "content": "a"}, {}), "role", None),
    (line({"role": "user", "content": 5}, {}), "content_type", ", message 1: 'content' must be a string"),
    (line({"role": "user", "content": None}, {}), "content_type", ", message 1: 'content' must be a string"),
    (line(U, {"role": "assistant", "content": {"a": 1}}), "content_type", ", message 2: 'content' must be a string"),
    (line({"role": "user", "content": " 　\x85"}, {}), "content_empty", ", message 1: 'content' cannot be empty"),
    (line(A, A), "no_user", ": conversation must have at least one 'user' message"),
    (line(U, U), "no_assistant", ": conversation must have at least one 'assistant' message"),
    (line({"role": "system", "content": "s"}, A), "no_user", None),
]


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_every_rule_has_its_message(spark):
    df = spark.createDataFrame(
        [("d", i, text) for i, (text, _, _) in enumerate(GOLDEN, 1)], "dataset_id string, line_no bigint, line string"
    )
    got = {r.line_no: r for r in validate_lines(df).collect()}
    for i, (text, code, message) in enumerate(GOLDEN, 1):
        assert got[i].error_code == code, text
        assert got[i].messages is None and got[i].raw is None
        if message:
            assert got[i].message == f"Line {i}{message}", text


def test_valid_lines_keep_messages_and_extras(spark):
    text = line({**U, "name": "x"}, A, id=3, tags=["t"])
    df = spark.createDataFrame([("d", 1, text)], "dataset_id string, line_no bigint, line string")
    row = validate_lines(df).withColumn("raw", F.to_json("raw")).first()
    assert row.error_code is None and row.message is None
    assert [tuple(m) for m in row.messages] == [("user", "a"), ("assistant", "b")]
    assert json.loads(row.raw) == json.loads(text)


def test_duplicate_keys_take_the_last(spark):
    text = '{"messages": 1, "messages": [{"role": "user", "content": "a"}, {"role": "bot", "role": "assistant", "content": "b"}]}'
    df = spark.createDataFrame([("d", 1, text)], "dataset_id string, line_no bigint, line string")
    assert validate_lines(df).first().error_code is None


FILES = {
    "plain.jsonl": OK + "\n" + OK + "\n",
    "blanks.jsonl": "\n \n" + OK + "\n\n\t\n" + OK + "\n{bad\n\n",
    "crlf.JSONL": OK + "\r\n" + "\r\n" + OK + "\r\n[1]",
    "bom.jsonl": b"\xef\xbb\xbf" + (OK + "\n" + OK).encode(),
    "bom blank.jsonl": b"\xef\xbb\xbf\n" + OK.encode(),
    "latin 1+.jsonl": line(U, {"role": "assistant", "content": "café ÿ"}).encode("latin-1") + b"\n" + OK.encode(),
    "accents.jsonl": line(U, {"role": "assistant", "content": "Åé"}) + "\n",
    "empty.jsonl": "",
    "white.jsonl": " \n\t\n",
}


def expected_lines(data):
    data = data if isinstance(data, bytes) else data.encode()
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    lines = enumerate(text.strip().splitlines(), 1)
    return {i: part.strip() for i, part in lines if part.strip()}


@pytest.fixture
def folder(tmp_path):
    for name, data in FILES.items():
        write(tmp_path / name, data)
    write(tmp_path / "other.csv", "a,b\n")
    write(tmp_path / "noext", "a")
    return tmp_path


def test_both_scans_number_lines_alike(spark, folder):
    for lines in (jsonl.read_lines(spark, str(folder)), jsonl.scan_lines(spark, str(folder))):
        got = {}
        for r in lines.collect():
            got.setdefault(r.dataset_id, {})[r.line_no] = r.line
        for name, data in FILES.items():
            want = expected_lines(data)
            if name == "bom blank.jsonl":
                want = {1: OK}
            assert got.get(name, {}) == want, name
        assert "other.csv" not in got


def test_unicode_line_boundaries_split_in_whole_file_reader(spark, tmp_path):
    data = OK + " " + OK + "\x0b" + OK + "\x85" + '{"messages": ["a b"]}'
    write(tmp_path / "u.jsonl", data)
    got = {r.line_no: r.line for r in jsonl.read_lines(spark, str(tmp_path)).collect()}
    assert got == expected_lines(data) and len(got) == 5


def test_splittable_scan_counts_over_blocks_and_parts(spark, tmp_path):
    rows = [line(U, {"role": "assistant", "content": f"answer {i} " + "x" * (i % 50)}) for i in range(4000)]
    for i in range(0, 4000, 7):
        rows[i] = ""
    data = "\n".join(["", "  ", *rows])
    write(tmp_path / "big.jsonl", data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        scanned = jsonl.scan_lines(spark, str(tmp_path))
        assert scanned.rdd.getNumPartitions() > 5
        got = {r.line_no: r.line for r in scanned.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == expected_lines(data)


def test_lines_stay_when_files_are_split_otherwise_later(spark, tmp_path):
    """The split layout between the call and the action follows the executors alive."""
    write(tmp_path / "big.jsonl", "".join(f'{{"n": {k}}}\n' for k in range(40_000)).encode())
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    try:
        for before, after in ((("2", "64m", "64m"), ("3", "64m", "1")), (("3", "50k", "1"), ("1", "7k", "1"))):
            for name, value in zip(names, before):
                spark.conf.set(name, value)
            lines = jsonl.scan_lines(spark, str(tmp_path))
            for name, value in zip(names, after):
                spark.conf.set(name, value)
            numbers = [(r.line_no, r.line) for r in lines.collect()]
            assert sorted(numbers) == [(k + 1, f'{{"n": {k}}}') for k in range(40_000)]
    finally:
        for name in names:
            spark.conf.unset(name)


def test_scan_without_broadcast_gives_the_same(spark, folder):
    want = sorted(map(tuple, jsonl.scan_lines(spark, str(folder)).collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, jsonl.scan_lines(spark, str(folder)).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_both_readers_split_at_unicode_boundaries(spark, tmp_path):
    text = "\n \u2028{a}\x85{b}\u2029\n{c}\x1c{d}\r\n{e}\x0b\x0c{f}"
    write(tmp_path / "u.jsonl", text)
    (tmp_path / "latin.jsonl").write_bytes(b"{\xe9}\x85{b}\n{\xff}")
    want = sorted(map(tuple, jsonl.read_lines(spark, str(tmp_path)).select("dataset_id", "line_no", "line").collect()))
    got = sorted(map(tuple, jsonl.scan_lines(spark, str(tmp_path)).select("dataset_id", "line_no", "line").collect()))
    assert got == want
    assert [r[1:] for r in want if r[0] == "u.jsonl"] == [(1, "{a}"), (2, "{b}"), (4, "{c}"), (5, "{d}"), (6, "{e}"), (8, "{f}")]


def test_parts_of_a_dataset_are_numbered_through(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder / "same.jsonl", "\n".join(["", line(U, A), line(A, U), ""]))
    read, _ = jsonl.read_jsonl(spark, str(tmp_path))
    scanned, _ = jsonl.scan_jsonl(spark, str(tmp_path))
    keys = sorted((r.dataset_id, r.conv_id) for r in read.collect())
    assert len(set(keys)) == 4 and keys == sorted((r.dataset_id, r.conv_id) for r in scanned.collect())


def test_no_cap_unless_asked_and_a_reject_for_each_file(spark, folder):
    _, rejects = jsonl.read_jsonl(spark, str(folder))
    assert rejects.where("error_code = 'too_large'").count() == 0
    for reader in (jsonl.read_jsonl, jsonl.scan_jsonl):
        chats, rejects = reader(spark, str(folder), max_bytes=0)
        assert chats.count() == 0
        assert rejects.where("error_code = 'too_large'").count() > 0


def test_file_gates(spark, folder):
    _, rejects = jsonl.read_jsonl(spark, str(folder), max_bytes=150)
    got = {r.dataset_id: (r.error_code, r.message) for r in rejects.where("line_no = 0").collect()}
    assert got["other.csv"] == ("extension", "Unsupported format: .csv. Please upload a .jsonl file.")
    assert got["noext"] == ("extension", "Unsupported format: . Please upload a .jsonl file.")
    assert got["blanks.jsonl"][0] == "too_large"
    assert "plain.jsonl" in got and "bom blank.jsonl" not in got
    at_cap = len(FILES["accents.jsonl"].encode())
    _, rejects = jsonl.read_jsonl(spark, str(folder), max_bytes=at_cap)
    assert "accents.jsonl" not in {r.dataset_id for r in rejects.where("error_code = 'too_large'").collect()}


def test_missing_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="File not found"):
        jsonl.read_jsonl(spark, str(tmp_path / "none"))


def test_first_five_errors_and_gates(spark, tmp_path):
    write(tmp_path / "six.jsonl", "\n".join([OK] * 60 + ["[1]"] * 6))
    write(tmp_path / "none.jsonl", "[1]\n")
    write(tmp_path / "few.jsonl", "\n".join([OK] * 49))
    write(tmp_path / "enough.jsonl", "\n".join([OK] * 50))
    validated = validate_lines(jsonl.read_lines(spark, str(tmp_path)))
    errors = {r.dataset_id: r.error_msg for r in error_summary(validated, "line_no").collect()}
    want = [f"Line {i}: must be a JSON object, got list" for i in range(61, 66)]
    assert errors["six.jsonl"] == "\n".join(["Validation failed:", *want])
    strict = {r.dataset_id: r for r in dataset_gate(validated, "line_no").collect()}
    assert {k for k, r in strict.items() if r.accepted} == {"enough.jsonl"}
    assert strict["few.jsonl"].error_msg == "Need at least 50 examples for fine-tuning. Found only 49."
    assert strict["six.jsonl"].error_msg == errors["six.jsonl"]
    loose = dataset_gate(validated, "line_no", strict=False)
    kept = {r.dataset_id: r for r in loose.collect()}
    assert {k for k, r in kept.items() if r.accepted} == {"enough.jsonl", "six.jsonl"}
    assert kept["none.jsonl"].error_msg == "File is empty or contains no valid examples."
    counts = {r.dataset_id: r["count"] for r in accepted_rows(jsonl.chats_of(validated), loose).groupBy("dataset_id").count().collect()}
    assert counts == {"enough.jsonl": 50, "six.jsonl": 60}


def test_written_lines_read_back_in_order(spark, tmp_path):
    rows = [line(U, {**A, "note": i}, id=i) for i in range(200)]
    write(tmp_path / "a b+c.jsonl", "\n".join(rows))
    chats, _ = jsonl.read_jsonl(spark, str(tmp_path))
    out = tmp_path / "out"
    sinks.write_jsonl(chats, str(out))
    parts = sorted(p for p in out.iterdir() if p.name.startswith("part-"))
    again = [json.loads(text) for p in parts for text in p.read_text().splitlines()]
    assert again == [json.loads(text) for text in rows]


def exported(spark, tmp_path, names=("a b+c.jsonl", "d%20=é.jsonl")):
    from parley.operators.manifest import training_manifests

    (tmp_path / "in").mkdir()
    for name in names:
        write(tmp_path / "in" / name, "\n".join(line(U, A, id=i, file=name) for i in range(30)))
    chats, _ = jsonl.read_jsonl(spark, str(tmp_path / "in"))
    plans = chats.groupBy("dataset_id").agg(F.count("*").alias("num_examples")).withColumn("base_model", F.lit("m"))
    return chats, training_manifests(plans)


def ids_of(chats):
    rows = chats.select("dataset_id", "line_no", F.variant_get("raw", "$.id", "int").alias("id")).collect()
    return {(r.dataset_id, r.line_no, r.id) for r in rows}


def test_export_reads_back_by_partition(spark, tmp_path):
    chats, manifests = exported(spark, tmp_path)
    root = str(tmp_path / "sets")
    export = sinks.export_training_sets(chats, manifests, root)
    names = ("a b+c.jsonl", "d%20=é.jsonl")
    want = {(n, i + 1, i) for n in names for i in range(30)}
    again, rejects = jsonl.scan_jsonl(spark, sinks.data_files(root, export), by="partition", suffix=".txt")
    assert ids_of(again) == want and rejects.count() == 0
    configs, chats = sinks.read_training_sets(spark, root)
    assert ids_of(chats) == want
    assert {r.dataset_id: json.loads(r.config)["data_path"] for r in configs.collect()} == dict.fromkeys(names, "./file=data.jsonl")
    folders = [f for f in (tmp_path / "sets/sets" / f"export={export}").iterdir() if f.is_dir()]
    assert len(folders) == 2
    for folder in folders:
        assert spark.read.text(str(folder / "file=data.jsonl")).count() == 30
        assert spark.read.text(str(folder / "file=config.json")).count() == 1
    listed = sinks.published_files(spark, root)
    assert listed.where("file = 'data.jsonl'").agg(F.sum("n_rows")).first()[0] == 60
    told = sinks.published_exports(spark, root).collect()
    assert [(r.export, r.n_files, r.n_rows) for r in told] == [(export, listed.count(), 62)]


def test_a_killed_export_is_invisible_and_altered_files_are_told(spark, tmp_path, monkeypatch):
    chats, manifests = exported(spark, tmp_path)
    root = str(tmp_path / "sets")
    with pytest.raises(FileNotFoundError):
        sinks.read_training_sets(spark, root)
    staged = sinks._staged_files

    def killed(*args):
        raise RuntimeError("killed")

    def killed_export(mode):
        monkeypatch.setattr(sinks, "_staged_files", killed)
        with pytest.raises(RuntimeError, match="killed"):
            sinks.export_training_sets(chats, manifests, root, mode)
        monkeypatch.setattr(sinks, "_staged_files", staged)

    killed_export("errorifexists")
    with pytest.raises(FileNotFoundError):
        sinks.read_training_sets(spark, root)
    first = sinks.export_training_sets(chats, manifests, root)
    with pytest.raises(ValueError, match="already"):
        sinks.export_training_sets(chats, manifests, root)
    one = chats.where("dataset_id like 'a%'")
    killed_export("overwrite")
    assert ids_of(sinks.read_training_sets(spark, root)[1]) == ids_of(chats)
    second = sinks.export_training_sets(one, manifests.where("dataset_id like 'a%'"), root, "overwrite")
    assert ids_of(sinks.read_training_sets(spark, root)[1]) == ids_of(one)
    assert ids_of(sinks.read_training_sets(spark, root, first)[1]) == ids_of(chats)
    parts = sorted((tmp_path / "sets/sets" / f"export={second}").glob("*/file=data.jsonl/part-*"))
    text = parts[0].read_text()
    parts[0].write_text(text.replace('"id":1,', '"id":2,', 1))
    (parts[0].parent / f".{parts[0].name}.crc").unlink()
    with pytest.raises(ValueError, match="differ"):
        sinks.read_training_sets(spark, root)
    assert sinks.read_training_sets(spark, root, verify=False)[1].count() == 30
