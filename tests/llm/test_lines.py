import random
from collections import Counter

import pytest

from parley.llm.lines import BLANKS, LineRuns, drop_common_lines


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def by_hand(texts, least):
    split = [(t or "").split("\n") for t in texts]
    counts = Counter(k for lines in split for k in {key(x) for x in lines} if k)
    kept = [[x for x in lines if counts[key(x)] < least] for lines in split]
    return [(len(a), len(a) - len(b), "\n".join(b)) for a, b in zip(split, kept)]


def test_lines_of_many_documents_go(spark):
    draw = random.Random(3)
    lines = ["Same line", " same LINE\t", "", "  ", "É x", "é x", "a\rb", "\xa0same line", *[f"own {i}" for i in range(60)]]
    texts = ["\n".join(draw.choices(lines, k=draw.randint(0, 12))) for _ in range(150)]
    texts += ["", None, "\n", "Same line", "Same line", "same line\n" * 3000]
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    for least, batches in ((3, 1), (3, 5), (10, 4), (1000, 2)):
        got = drop_common_lines(docs, min_docs=least, batches=batches).collect()
        wanted = sorted((str(r[0]), str(r[1]), *h) for r, h in zip(rows, by_hand(texts, least)))
        assert sorted((str(r.row.doc_id), str(r.row.text), r.n_lines, r.n_dropped, r.kept) for r in got) == wanted


def test_runs_are_merged_by_level(spark):
    runs = LineRuns(spark, min_docs=4, buckets=2)
    total = Counter()
    for batch in range(5):
        counts = {k: 1 + (k + batch) % 3 for k in range(batch, batch + 6)}
        total.update(counts)
        runs.add(spark.createDataFrame([(k, -k, n) for k, n in counts.items()], "h1 bigint, h2 bigint, n bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {r.h1 for r in runs.common().collect()} == {k for k, n in total.items() if n >= 4}
    plan = runs.merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.drop()


def test_empty_table(spark):
    assert drop_common_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_buckets_follow_the_keys_and_failed_batches_leave_no_table(spark, monkeypatch):
    from parley.llm import lines

    assert [lines.buckets_for(n) for n in (0, 32_000_000, 32_000_001, 10**12)] == [16, 16, 17, 100_000]
    before = {t.name for t in spark.catalog.listTables()}
    add = lines.LineRuns.add

    def failing(self, counts):
        add(self, counts)
        if len(self.runs()) > 0:
            raise RuntimeError("lost")

    monkeypatch.setattr(lines.LineRuns, "add", failing)
    with pytest.raises(RuntimeError, match="lost"):
        lines.drop_common_lines(spark.createDataFrame([(1, "a\nb")], "doc_id int, text string"))
    assert {t.name for t in spark.catalog.listTables()} == before
