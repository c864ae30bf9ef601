from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from parley.llm.periods import lyndon_array, periodic_runs, repeating_spans, runs_of
from parley.llm.queries import op13_periodic_runs, repeated_from_within


def plain_runs(words, least, exponent):
    """Every run by comparing all places at all distances."""
    n, found = len(words), []
    for period in range(1, n // exponent + 1):
        start = 0
        while start + period < n:
            at = start
            while at + period < n and words[at] == words[at + period]:
                at += 1
            length = at - start + period
            run = words[start : start + length]
            smaller = any(all(a == b for a, b in zip(run, run[q:])) for q in range(1, period))
            if at > start and length >= max(least, exponent * period) and not smaller:
                found.append((start, length, period))
            start = at + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def plain_answer(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words, 6, 4)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def sequences(count):
    random.seed(11)
    for _ in range(count):
        letters = random.choice([1, 2, 2, 3, 5])
        s = [random.randrange(letters) for _ in range(random.randint(0, 30))]
        root = [random.randrange(letters) for _ in range(random.randint(1, 6))]
        yield s + (root * 9)[: random.randint(0, 40)] + s[:7]


def test_lyndon_array_is_that_of_its_definition():
    for s in sequences(300):
        for word in (s, [-x for x in s]):
            want = []
            for i in range(len(word)):
                j = i + 1
                while j < len(word) and word[j:] > word[i:]:
                    j += 1
                want.append(j - i)
            assert lyndon_array(word) == want


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (9, 3), (8, 2)])
def test_runs_of_neighbouring_documents_equal_brute_force(least, exponent):
    for s in sequences(250):
        k = random.randint(0, len(s))
        parts = [s[:k], s[k:]]
        sizes = np.array([k, len(s) - k])
        ends, spans = np.cumsum(sizes), {0: [], 1: []}
        symbols = np.array(s, np.int64)
        for d, begin, end in repeating_spans(symbols, np.repeat([0, 1], sizes), ends, least, exponent):
            spans[d].append((begin - ends[d] + sizes[d], end - ends[d] + sizes[d]))
        for d, part in enumerate(parts):
            assert runs_of(np.array(part, np.int64), spans[d], least, exponent) == plain_runs(part, least, exponent)


def test_periods_without_repeats_leave_nothing_to_look_at():
    words = np.arange(10_000) % 3_000
    assert repeating_spans(words, np.zeros(10_000, int), np.array([10_000]), 6, 4) == []
    assert repeating_spans(words, np.zeros(10_000, int), np.array([10_000]), 6, 3) == [(0, 0, 10_000)]


def test_query_equals_brute_force(spark, tmp_path):
    random.seed(5)
    vocabulary = ["a", "b", "É", "x y", "zz"]
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "go go go go go go"), (5, "go " * 5), (None, "a a a a a a a")]
    for k in range(6, 160):
        size = random.choice([0, 1, 2, 5, 30, 120])
        rows.append((k, random.choice([" ", "\n", "  "]).join(random.choice(vocabulary[: random.randint(1, 5)]) for _ in range(size))))
    rows += rows[10:20]  # repeated rows
    rows.append((1000, " ".join(str(i % 977) for i in range(30_000))))  # a very long text that is one run
    rows.append((1001, " ".join(str(random.random()) for _ in range(30_000))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df.selectExpr("*", "text AS collapsed", "doc_id AS n_runs", "1 AS w", "2 AS n", "3 AS g")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()]
    key = lambda r: (str(r[0]), r[7])
    planted = [r for r in rows if r[0] not in (None, 1000, 1001)]
    # A text without id is taken as it is.
    want = [plain_answer(*r) for r in planted]
    assert sorted((r for r in got if r[0] not in (None, 1000, 1001)), key=key) == sorted(want, key=key)
    of = {r[0]: r for r in got if r[0] in (None, 1000, 1001)}
    assert of[None][1:6] == (1, 0, 7, 1, 7000)
    assert of[1000][1:6] == (1, 0, 30_000, 977, 30_706) and zlib.crc32(b"1000") % 10
    assert of[1001][1:6] == (0, None, None, None, None)
    assert sum(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5


def test_runs_and_collapsed_text_come_whole(spark):
    df = spark.createDataFrame([(7, "well no no no no no no then ha hu ha hu ha hu ha hu end")], "key int, body string")
    row = periodic_runs(df, id_col="key", text_col="body").collect()[0]
    assert row.runs == "1,6,1\n8,8,2\n" and row.collapsed == "well no then ha hu end" and row.n_words == 17
    assert (row.start, row.length, row.period, row.exponent_milli) == (8, 8, 2, 4000)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert periodic_runs(empty).collect() == [] and repeated_from_within(empty).collect() == []
