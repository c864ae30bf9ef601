from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import phrases
from parley.llm.phrases import Scan, blocks, collocations, distinct_windows, frequent_phrases, score

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(" ".join(w[i : i + m]) for i in range(len(w) - m + 1))
    return counts, words


def plain_answer(rows, threshold, longest, top, share=100):
    counts, words = plain_counts(rows, longest)
    found = []
    for lang, f in counts.items():
        cands = {p: c for p, c in f.items() if " " in p and c >= threshold}
        kept = []
        for p, a in cands.items():
            w = p.split(" ")
            if any(f" {p} " in f" {q} " and q != p and 100 * c >= share * a for q, c in cands.items()):
                continue
            cuts = []
            for k in range(1, len(w)):
                left, right = f[" ".join(w[:k])], f[" ".join(w[k:])]
                cuts.append((1000 * a * words[lang] // (left * right), k, left, right))
            value, _, left, right = min(cuts)
            kept.append((-value, -a, p.encode(), p, a, left, right, words[lang], value))
        found += [(lang, i + 1, *row[3:]) for i, row in enumerate(sorted(kept)[:top])]
    return sorted(found)


def table(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return df.selectExpr("*", "text AS phrase", "1 AS a", "2 AS shard", "lang AS n")


def made(count, seed=3):
    random.seed(seed)
    words = ["a", "B", "b", "cc", "Été", "d d", "\x1c", "ß"]
    rows = [(None, None), ("en", None), (None, "a b a b a b a b"), ("en", ""), ("de", " \t. ,\n"), ("xx", "lonely")]
    for _ in range(count):
        size = random.choice([0, 1, 3, 20, 60])
        joint = [random.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]) for _ in range(size)]
        rows.append((random.choice(["en", "de", None]), "".join(random.choice(words) + j for j in joint)))
    return rows + rows[-9:]


@pytest.mark.parametrize("shards,threshold,share", [(1, 5, 100), (3, 12, 100), (4, 5, 60)])
def test_equals_brute_force_however_the_texts_are_dealt(spark, shards, threshold, share):
    rows = made(120)
    got = collocations(table(spark, rows), threshold, top=40, share=share, shards=shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_answer(rows, threshold, 5, 40, share)


def test_phrases_that_reach_the_threshold_last_are_counted_whole(spark, monkeypatch):
    """Words and phrases below the threshold until their last shard, with slots that everything shares."""
    rows = [("en", "p q r s t")] * 8 + [("en", "p q x"), ("en", "r s t")]
    want, words = plain_counts(rows, 5)
    for slots in (1 << 20, 8):
        monkeypatch.setattr(phrases, "LEAST_SLOTS", slots)
        found = frequent_phrases(table(spark, rows).select("lang", "text"), 8, 5, 4).collect()
        assert {r.phrase: r.f for r in found if r.m} == {p: c for p, c in want["en"].items() if c >= 8}
        assert [(r.lang, r.f) for r in found if r.m == 0] == [("en", words["en"])]


def test_blocks_of_a_long_text_lose_no_window(monkeypatch):
    random.seed(2)
    text = b" ".join(random.choice([b"aa", b"b", b"c.d", b"e"]) for _ in range(3000))
    want, _ = plain_counts([("en", text.decode())], 4)
    monkeypatch.setattr(phrases, "TOGETHER", 50)
    assert b"".join(blocks(text)) == text and len(list(blocks(text))) > 50
    got = Counter()
    # Everything is reached before the first step, so all lengths are active.
    for batch in Scan(1, 2, np.zeros((3, 1 << 10), np.uint8), [0] * 5).counted("en", text):
        for row in batch.to_pylist():
            if row["m"]:
                got[row["phrase"]] += row["f"]
    assert got == want["en"]


@pytest.mark.parametrize("size,m", [(3, 1), (3, 5), (2**20, 5), (2**31, 5), (2**31, 2)])
def test_distinct_windows_are_exact_for_many_codes(size, m):
    random.seed(4)
    codes = np.array([random.choice([0, 1, size - 2, size - 1]) for _ in range(500)])
    starts = np.arange(400)
    columns, counts = distinct_windows(codes, starts, m, size)
    want = Counter(tuple(codes[i : i + m].tolist()) for i in range(400))
    assert dict(zip(zip(*[c.tolist() for c in columns]), counts.tolist(), strict=True)) == want


def test_score_is_exact_beyond_64_bits(spark):
    rows = [(10**14, 9 * 10**14, 10**14 + 1, 10**14 + 7), (100, 10**15 - 1, 100, 101), (7, 11, 7, 13)]
    got = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint")
    got = got.select(score(*map(F.col, "anlr"))).collect()
    assert [r[0] for r in got] == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_empty_table_gives_no_rows(spark):
    assert collocations(table(spark, [("en", "x")]).where("false")).collect() == []
