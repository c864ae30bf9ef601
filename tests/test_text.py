from __future__ import annotations

import random

from pyspark.sql import functions as F

from parley.functions import text as T

SAMPLES = [
    "", " ", "a", " a ", "\x1ca\x1f", " 　x ", "​x​", "﻿x", "a b\n", "\x85é\x85", "\n\t\x0b\x0c\r",
    "  {\"a\": 1}", " [1]", "x{", "K", "ΑΣ", "ß", "😀",
]


def test_text_primitives_agree_with_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    s = F.col("s")
    rows = df.select(
        s,
        T.strip(s).alias("strip"),
        T.is_blank(s).alias("blank"),
        T.has_non_ascii(s).alias("wide"),
        T.looks_like_json(s).alias("json"),
        T.normalised(s).alias("norm"),
        T.snippet(s, 3).alias("snip"),
    ).collect()
    for r in rows:
        assert r.strip == r.s.strip(), repr(r.s)
        assert r.blank == (not r.s.strip())
        assert r.wide == any(ord(c) > 127 for c in r.s)
        assert r.json == r.s.strip().startswith(("{", "["))
        assert r.norm == r.s.strip().lower()
        assert r.snip == (r.s[:3] + "..." if len(r.s) > 3 else r.s)


def test_line_separator_agrees_with_python(spark):
    text = "a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l\n\nm"
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(T.split_lines(F.col("s"))).first()[0] == text.splitlines()


def test_rounding_agrees_with_python(spark):
    rng = random.Random(7)
    pairs = [(n, d) for d in range(1, 81) for n in range(0, 90)]
    pairs += [(rng.randrange(10**9), rng.randrange(1, 10**6)) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    x = T.safe_ratio(F.col("n"), F.col("d"))
    rows = df.select(
        "n", "d", T.round_one_decimal(x).alias("one"), T.round_half_even(x).alias("even"),
        T.floor_div(F.col("n"), F.col("d")).alias("div"), T.round_half_up(x).alias("up"),
    ).collect()
    for r in rows:
        assert r.one == round(r.n / r.d, 1), (r.n, r.d)
        assert r.even == round(r.n / r.d)
        assert r["div"] == r.n // r.d
        assert r.up == (2 * r.n + r.d) // (2 * r.d) or abs(r.n / r.d % 1 - 0.5) < 1e-9


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0)], "n bigint, d bigint")
    row = df.select(T.safe_ratio(F.col("n"), F.col("d")), T.floor_div(F.col("n"), F.col("d"))).first()
    assert list(row) == [None, None]
