import random
import re
from itertools import combinations

import pytest

from parley.llm import ngrams
from parley.llm.common import components
from parley.llm.ngrams import near_duplicates


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        r = root(k)
        least[r] = min((i for i in (least.get(r), doc_id) if i is not None), default=None)
    return sorted(((d, len(s), least[root(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = draw.choices(words, k=60)
    texts = []
    for _ in range(25):
        base = draw.choices(words, k=draw.choice([3, 5, 8, 40, 120]))
        if draw.random() < 0.5:
            # A passage that many documents share, from hardly to mostly.
            base = base + passage[: draw.choice([20, 40, 60])]
        for _ in range(draw.choice([1, 1, 2, 5, 14])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            texts.append(draw.choice([" ", "\n", " \t"]).join(copy))
    texts += ["", None, " \n ", "One", "one", "É b c d e f", "é b c d e f", "a\xa0b c", "a b c", "x " * 900, "X " * 900]
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    return rows + [(0, texts[0]), (None, texts[3]), (None, None), (1, texts[5])]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("most", [2, 64])
def test_components_equal_all_pairs(spark, seed, most):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, component_id int")
    got = near_duplicates(docs, most=most).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == by_hand(rows)


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_candidates_of_a_cluster_do_not_grow_with_its_square(spark, monkeypatch):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    base = draw.choices(words, k=60)
    rows = [(0, " ".join(base))]
    for k in range(1, 150):
        copy = list(base)
        copy[draw.randrange(60)] = draw.choice(words)
        rows.append((k, " ".join(copy)))
    asked = []
    verified = ngrams.verified
    monkeypatch.setattr(ngrams, "verified", lambda pairs, sets: asked.append(pairs.count()) or verified(pairs, sets))
    # Stars that find nothing: all is left to the prefix join.
    monkeypatch.setattr(ngrams, "star_pairs", lambda classes: classes.selectExpr("s AS a", "s AS b").limit(0))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == by_hand(rows)
    assert len(asked) > 2 and sum(asked) < 20 * len(rows)


def test_near_copies_that_do_not_link_are_hardly_compared(spark, monkeypatch):
    draw = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    base = draw.choices(words, k=200)
    rows = []
    for k in range(120):
        copy = list(base)
        for at in draw.sample(range(200), 9):
            copy[at] = draw.choice(words)
        rows.append((k, " ".join(copy)))
    asked, dealt = [], []
    verified, written_once = ngrams.verified, ngrams.written_once

    def traced(df, purpose):
        if purpose == "postings":
            dealt.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(token"))
        return written_once(df, purpose)

    monkeypatch.setattr(ngrams, "verified", lambda pairs, sets: asked.append(pairs.count()) or verified(pairs, sets))
    monkeypatch.setattr(ngrams, "written_once", traced)
    monkeypatch.setattr(ngrams, "star_pairs", lambda classes: classes.selectExpr("s AS a", "s AS b").limit(0))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), most=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == by_hand(rows)
    assert sum(asked) < 5 * len(rows)
    # The large table is dealt out once.
    assert dealt and set(dealt) == {1}


def test_parities_and_places_allow_every_link():
    import numpy as np

    draw = np.random.default_rng(4)
    for n in (1, 2, 5, 9, 40, 63, 64, 65, 500):
        for _ in range(60):
            # As many of their own as two sets that link can have, on one side or on both.
            own = int(n * 2 * 20 / 160 * draw.random() + 0.5)
            one = draw.integers(0, own + 1)
            items = draw.integers(0, 1 << 63, n + own).astype(np.uint64)
            x, y = np.unique(items[: n + one]), np.unique(np.concatenate([items[:n], items[n + one :]]))
            common = len(np.intersect1d(x, y))
            if 100 * common >= 80 * (len(x) + len(y) - common):
                assert ngrams.may_link(ngrams.parities(x), ngrams.parities(y), len(x) + len(y))
    x, y = (draw.integers(0, 1 << 63, 400).astype(np.uint64) for _ in range(2))
    assert not ngrams.may_link(ngrams.parities(x), ngrams.parities(y), 800)


def test_a_text_is_the_star_of_its_copies(spark, monkeypatch):
    draw = random.Random(7)
    words = [f"w{k}" for k in range(9000)]
    base = draw.choices(words, k=200)
    rows = [(500, " ".join(base))]
    for k in range(140):
        # Each copy links with the text, and with hardly any other copy.
        copy = list(base)
        for at in draw.sample(range(5, 195), 4):
            copy[at] = draw.choice(words)
        rows.append((k, " ".join(copy)))
    links = []
    verified = ngrams.verified

    def counted(pairs, sets):
        links.append(verified(pairs, sets))
        return links[-1]

    monkeypatch.setattr(ngrams, "verified", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == by_hand(rows)
    assert links[0].count() > 0.9 * len(rows)


def test_a_cluster_that_stars_have_missed_is_not_paired_whole(spark, monkeypatch):
    draw = random.Random(13)
    words = [f"w{k}" for k in range(3000)]
    base = draw.choices(words, k=60)
    rows = [(0, " ".join(base))]
    for k in range(1, 200):
        copy = list(base)
        copy[draw.randrange(60)] = draw.choice(words)
        rows.append((k, " ".join(copy)))
    made = []
    written_once = ngrams.written_once

    def traced(df, purpose):
        out = written_once(df, purpose)
        if purpose in ("drawn-pairs", "group-pairs"):
            made.append(out.count())
        return out

    monkeypatch.setattr(ngrams, "written_once", traced)
    monkeypatch.setattr(ngrams, "star_pairs", lambda sets: sets.selectExpr("s AS a", "s AS b").limit(0))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == by_hand(rows)
    # All pairs are 100 times so many as rows.
    assert max(made) < 40 * len(rows)


def shared_passage(spark, copies, each):
    """``copies`` texts that do not link and hold one passage, ``each`` in a task, and as many others."""
    draw = random.Random(17)
    words = [f"w{k}" for k in range(20000)]
    passage = draw.choices(words, k=60)
    rows = [(k, " ".join(draw.choices(words, k=15) + passage + draw.choices(words, k=15))) for k in range(copies)]
    # Some that do link.
    rows += [(copies, rows[0][1] + " more"), (copies + 1, rows[1][1] + " more")]
    rows += [(1000 + k, " ".join(draw.choices(words, k=90))) for k in range(copies)]
    rows += [(2000, rows[-1][1] + " more")]
    parts = spark.sparkContext.parallelize(rows, -(-len(rows) // each))
    return rows, spark.createDataFrame(parts, "doc_id bigint, text string")


def made_anew(monkeypatch):
    made = []
    prefixes = ngrams.prefixes
    monkeypatch.setattr(ngrams, "prefixes", lambda docs, *rest: made.append(docs.count()) or prefixes(docs, *rest))
    return made


def test_shingles_that_blocks_tell_rarely_are_demoted_at_once(spark, monkeypatch):
    # A gigabyte or six: a shingle of a thousand texts, of which blocks tell a hundred.
    rows = [(1_500_000_000, 0), (-50, 7), (-50, 7), (-80, 8), (-10, 9), (-400, 10)]
    scan = spark.createDataFrame(rows, "n bigint, s bigint")
    assert ngrams.frequent(scan, 64).tolist() == [7, 8, 10]
    monkeypatch.setattr(ngrams, "MOST", 2)
    assert ngrams.frequent(scan, 64).tolist() == [10]


def test_later_demotions_make_only_prefixes_anew_that_change(spark, monkeypatch):
    rows, docs = shared_passage(spark, 20, 1)
    made = made_anew(monkeypatch)
    got = near_duplicates(docs, most=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == by_hand(rows)
    assert len(made) > 1 and made[0] == len(rows) and max(made[1:]) <= 22


def test_few_pairs_of_crowded_shingles_demote_none(spark, monkeypatch):
    rows, docs = shared_passage(spark, 20, 1)
    # So many other texts that the passage's pairs are few beside their shingles.
    draw = random.Random(19)
    words = [f"v{k}" for k in range(20000)]
    rows += [(3000 + k, " ".join(draw.choices(words, k=3000))) for k in range(20)]
    parts = spark.sparkContext.parallelize(rows, len(rows))
    made = made_anew(monkeypatch)
    got = near_duplicates(spark.createDataFrame(parts, "doc_id bigint, text string"), most=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == by_hand(rows)
    assert made == [len(rows)]
