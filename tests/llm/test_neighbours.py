import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm.neighbours import nearest


def by_hand(rows, k, every):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 6 and None not in v:
            if np.isfinite(v).all() and np.any(v):
                good.setdefault(i, np.array(v, float))
    out = {}
    for q in (i for i in good if i % every == 0):
        scores = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q)
        out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("hot", [0, 150])
def test_all_lists_probed_equals_brute_force(spark, hot):
    draw = np.random.default_rng(4)
    rows = [(i, draw.standard_normal(6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(hot)] + [(rows[3][0], rows[3][1])]
    nan, inf = float("nan"), float("inf")
    rows += [(600, None), (605, [0.0] * 6), (610, [1.0, None] + [0.0] * 4), (615, [nan] * 6), (620, [inf] * 6)]
    rows += [(None, [1.0] * 6), (625, [1.0] * 5), (630, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    for block, query_block in ((20_000, 2_000), (40, 7)):
        got = nearest(df, F.col("vec_id") % 5 == 0, k=4, pivots=16, posted=16, probed=16, block=block, query_block=query_block)
        answers = {}
        for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
            answers.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
        expected = by_hand(rows, 4, 5)
        assert set(answers) == set(expected)
        for q, wanted in expected.items():
            assert [a[0] for a in answers[q]] == [w[0] for w in wanted]
            assert [a[2] for a in answers[q]] == [1, 2, 3, 4]
            assert np.allclose([a[1] for a in answers[q]], [w[1] for w in wanted], rtol=1e-12)


def test_recall(spark):
    draw = np.random.default_rng(9)
    data = draw.standard_normal((3000, 32)).astype(np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<float>")
    got = nearest(df, F.col("vec_id") % 20 == 0, k=10).collect()
    hits = 0
    for q in range(0, 3000, 20):
        scores = data @ data[q]
        scores[q] = -9
        true = set(np.argsort(-scores)[:10].tolist())
        hits += len(true & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 1500 and hits / 1500 >= 0.9


def test_empty_and_few(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(few.limit(1), F.col("vec_id") % 20 == 0).count() == 0
    assert {(r.query_id, r.vec_id, r.score) for r in nearest(few, F.col("vec_id") % 20 == 0).collect()} == {(0, 20, 4.0), (20, 0, 4.0)}


@pytest.mark.parametrize("kind", ["dense", "lengths"])
def test_recall_in_a_dense_group_and_with_mixed_lengths(spark, kind):
    """A third of all rows near one vector, or lengths that differ: no candidate of a list is left out."""
    draw = np.random.default_rng(5)
    data = draw.standard_normal((9000, 64))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    if kind == "dense":
        data[::3] = data[0] + 0.05 * draw.standard_normal((3000, 64))
    else:
        data *= np.exp(0.5 * draw.standard_normal(9000))[:, None]
    data = data.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 60 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recalls = []
    for q in range(0, 9000, 60):
        scores = data.astype(float) @ data[q].astype(float)
        scores[q] = -np.inf
        recalls.append(len(got[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    print(kind, "recall", np.mean(recalls), "worst", min(recalls))
    assert np.mean(recalls) >= 0.95 and min(recalls) >= 0.6


def test_more_pivots_are_taken_as_given_and_lessen_the_work(spark, monkeypatch):
    from parley.llm import neighbours

    seen, posted = [], []
    permutations, written = neighbours.permutations, neighbours.written_once

    def noted(classes, pivots, kind, lists):
        seen.append(len(pivots))
        return permutations(classes, pivots, kind, lists)

    def kept(df, purpose):
        out = written(df, purpose)
        if purpose == "permutations":
            # Pairs to score: vectors posted in each of the lists that a vector looks into.
            lists = out.select("cid", F.posexplode("near").alias("at", "p"))
            sizes = lists.where("at < 3").groupBy("p").count()
            posted.append(lists.where("at < 5").join(sizes, "p").agg(F.sum("count")).first()[0])
        return out

    monkeypatch.setattr(neighbours, "permutations", noted)
    monkeypatch.setattr(neighbours, "written_once", kept)
    draw = np.random.default_rng(1)
    rows = [(i, draw.standard_normal(8).astype(np.float32).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for pivots in (40, 600):
        assert nearest(df, F.col("vec_id") % 50 == 0, k=3, pivots=pivots, posted=3, probed=5).count() == 120
    assert seen == [40, 600] and posted[1] < posted[0] / 4
