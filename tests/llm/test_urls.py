from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from parley.llm import urls
from parley.llm.queries import URL_RULES, op11_url_filter
from parley.llm.urls import SIZES, labelled_urls, odds_of, train_filter, url_features, url_verdicts

LOWER = str.maketrans(urls.UPPER, urls.LOWER)

URLS = [
    None, "", "no scheme/en/", "://", "https://", "http://COM", "http://com/", "http://com/en/", "http://x.COM/en/1?q=/es/",
    "http://example.com/en/", "http://Example.Com/en", "http://example.com/EN/1", "https://www.example.com/en/1#top",
    "https://a.www.example.com/en/9", "http://notexample.com/en/2", "http://com.example/en/", "ftp://u@a.net/es/1",
    "http://a.net/fr/2", "http://a.net:80/fr/2", "http://a.net/de/2://com/", "http://net?x=/es/", "http://net#/es/", "x://a.b.net/es/\n2",
    "http://ÉCOLE.com/ß", "http://.com/x", "http://com./x", "http://a..net/fr/", "http://www.\U0001f600.org/\U0001f600", "http://" + "long." * 30_000 + "net/es/",
    "http://poker-pills.example.org/en/4", "http://harbour-museum.example.org/en/4",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    ends = [rest.index(c) for c in "/?#" if c in rest]
    host = rest[: min(ends, default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def plain_odds(model, host, path):
    """The score from counted n-grams, bucket by bucket."""
    grams = [(part, f"<{t}>"[i : i + n]) for part, t in enumerate((host, path)) for n in SIZES for i in range(len(t) + 3 - n)]
    total = 0
    for (part, gram), times in Counter(grams).items():
        h = 2 * len(gram) + part
        for c in gram:
            h = (h * 0x110003 + ord(c)) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> shift)) * factor % 2**64
        total += times * int(model[(h ^ (h >> 31)) % urls.BUCKETS])
    return 1 / (1 + math.exp(-urls.UNIT * (int(model[-1]) + total / math.sqrt(max(1, len(grams))))))


@pytest.fixture(scope="module")
def model(spark):
    return train_filter(labelled_urls(spark))


def test_query_equals_plain_rules_and_scores(spark, tmp_path, model):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(None, URLS[9]), (3, URLS[9]), (3, URLS[9])]
    df = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'x' AS html", "1 AS host", "2 AS verdict")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = op11_url_filter(spark, str(tmp_path)).collect()
    want = []
    for page, url in rows:
        host, path, rule, verdict = plain(url)
        odds = plain_odds(model, host, path) if len(url or "") < 1000 else None
        want.append((page, host, path, rule, verdict or ("block" if odds >= 0.5 else "allow"), odds))
    key = lambda r: (str(r[0]), r[1], r[2])
    for mine, plainly in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert mine[:5] == plainly[:5]
        assert plainly[5] is None or abs(mine[5] - plainly[5]) < 1e-9
    assert {r.rule for r in got} == {None, *[h + p for h, p, _ in URL_RULES]}
    verdicts = {r.host: r.verdict for r in got}
    assert verdicts["poker-pills.example.org"] == "block" and verdicts["harbour-museum.example.org"] == "allow"


def test_names_that_were_not_learnt_are_told_apart(spark):
    """Every fifth name is held out, with all its shapes."""
    rows = labelled_urls(spark).collect()
    named = [r for r in rows if any(n in r.url for n in (*urls.WANTED, *urls.UNWANTED))]
    of = lambda r: r.url.split("://")[1].split(".example")[0].split(".")[-1]
    held = set(sorted({of(r) for r in named})[::5])
    learnt = spark.createDataFrame([r for r in rows if of(r) not in held], "url string, label string")
    model = train_filter(learnt)
    asked = [r for r in named if of(r) in held]
    hosts, paths = zip(*[plain(r.url)[:2] for r in asked])
    found = odds_of(model, list(hosts), list(paths)) >= 0.5
    right = [f == (r.label == "block") for f, r in zip(found, asked)]
    assert len(asked) > 100 and np.mean(right) >= 0.85


def test_training_takes_a_bounded_sample_and_only_known_labels(spark):
    table = labelled_urls(spark)
    other = spark.createDataFrame([(None, "block"), ("http://a.b/", "maybe"), ("http://a.b/", None)], "url string, label string")
    assert (train_filter(table.union(other)) == train_filter(table)).all()
    assert (train_filter(table, most=50) != train_filter(table)).any()
    untrained = train_filter(table.where("false"))
    assert not untrained.any() and (odds_of(untrained, ["x"], ["/"]) == 0.5).all()


def test_rules_ties_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x/y"), (2, "http://c.d/")], "page_id bigint, url string")
    table = labelled_urls(spark).limit(20)
    rules = [("b", "/x/", "allow"), ("b", "/x/", "block"), ("a.b", "/", "allow")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_verdicts(pages, rules, table).collect()}
    assert got[1] == ("b/x/", "block") and got[2][0] is None
    assert {r.rule for r in url_verdicts(pages, [], table).collect()} == {None}
    assert url_verdicts(pages.where("false"), rules, table).collect() == []
    with pytest.raises(ValueError):
        url_verdicts(pages, [("b", "/", "perhaps")], table)
    assert [len(x) for x in url_features([], [])] == [0, 0]
