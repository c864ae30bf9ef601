import base64
import hashlib

from parley.llm.warc import read_records, write_archives

ROWS = [
    (1, "http://a/", "<p>é</p>"),
    (2, "http://b/\r\nX: y", "<p>é</p>"),
    (3, None, ""),
    (4, "http://d/", None),
    (5, "http://e/", "\r\n\r\nWARC/1.1\r\n\r\n" * 50),
    (5, "http://e/", "\r\n\r\nWARC/1.1\r\n\r\n" * 50),
    (None, "http://n/", "<p>é</p>"),
    (None, None, "alone"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'no' AS file")


def expected(least):
    out = []
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "").encode() == data and p is not None]
        first = min(same, default=None)
        revisit = len(data) >= least and first is not None and page_id != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_roundtrip(spark, tmp_path):
    for least in (0, 5):
        folder = f"{tmp_path}/w{least}"
        index = write_archives(pages(spark), folder, least, file_bytes=700)
        got = read_records(index, folder).collect()
        fields = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
        assert sorted(fields, key=str) == expected(least)
        bodies = {r.page_id: r.payload for r in got if r.record_type == "response"}
        assert bodies[1] == "<p>é</p>" and bodies[5] == ROWS[4][2]


def test_selected_records_in_merged_ranges(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i} " * (i % 50)) for i in range(300)]
    folder = f"{tmp_path}/w"
    index = write_archives(pages(spark, rows), folder, file_bytes=4000)
    chosen = index.where("page_id % 7 = 0")
    for gap, most in ((0, 1), (100, 500), (1 << 20, 1 << 20)):
        got = {r.page_id: r.payload for r in read_records(chosen, folder, gap=gap, most=most).collect()}
        assert set(got) == {i for i, _, _ in rows if i % 7 == 0}
        # A page of no text is shared: only its first one holds the payload.
        assert all(got[i] == rows[i][2] for i in got if i % 50)


def test_no_pages(spark, tmp_path):
    index = write_archives(pages(spark, []), f"{tmp_path}/w")
    assert read_records(index, f"{tmp_path}/w").count() == 0


def test_reading_back_takes_as_many_tasks_as_the_bytes_call_for(spark, tmp_path, monkeypatch):
    from parley.llm import warc

    pages = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(string(id), 512), 40) AS html")
    index = warc.write_archives(pages, str(tmp_path))
    total = index.agg({"length": "sum"}).first()[0]
    monkeypatch.setattr(warc, "STRETCH", 2_000)
    monkeypatch.setattr(warc, "TASK_BYTES", total // 7 + 1)
    records = warc.read_records(index, str(tmp_path), payloads=False)
    assert records.rdd.getNumPartitions() == 7
    assert sorted(r.page_id for r in records.collect()) == list(range(300))
