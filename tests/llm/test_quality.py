import random
import zlib

import pytest

from parley.llm.quality import document_features, quality_scores, word_features


def corpus(n=400):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefg", k=draw.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for k in range(n):
        good = draw.random() < 0.7
        chosen = draw.choices(words, k=draw.randint(5, 60))
        kind = draw.randrange(3)
        if not good:
            chosen = [chosen[0]] * 30 if kind == 0 else [w.upper() + "!!" if kind == 1 else w + "$$$" for w in chosen]
        rows.append((k, " ".join(chosen)))
        labels.append((k, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus()
    rows = [*rows, (1000, None), (1001, ""), (1001, ""), (None, "abc def"), (1002, "x " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "9 AS score")
    # Conflicting and null labels take no part.
    marks = [*labels, (5, 1 - labels[5][1], 0), (None, 1, 0), (1001, None, 0)]
    table = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    return quality_scores(docs, table).collect(), {k: q for k, q, _ in labels}


def test_held_out_accuracy(scored):
    rows, labels = scored
    assert len(rows) == 405
    for r in rows:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.row.score == 9
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.95


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality_scores(docs, none).count() == 2
    assert quality_scores(docs.limit(0), none).count() == 0


def test_features_of_words_and_documents():
    words = [b"a", "é".encode(), b"longer", b"a"]
    owner, bucket = word_features(words)
    assert [list(owner).count(k) for k in range(4)] == [3 * len(w) + 1 for w in words]
    assert sorted(bucket[owner == 0]) == sorted(bucket[owner == 3])
    index, share = document_features(words)
    assert abs(share.sum() - 1) < 1e-6 and len(index) == len(set(index.tolist()))
