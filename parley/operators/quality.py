"""Quality score and issues per dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T

_COUNTS = (
    "n_examples",
    "duplicates",
    "blank_responses",
    "short_responses",
    "long_responses",
    "single_turn",
    "multi_turn",
    "with_system",
    "without_system",
)


def quality_counts(features: DataFrame, overall: bool = False) -> DataFrame:
    """The counts every check rests on.

    Distinct fingerprints are counted on (dataset, fingerprint) with map-side combining, so a
    fingerprint shared by very many copies arrives at its reducer as one row per task. ``overall`` adds a
    row for all datasets together, marked ``is_overall``, where a fingerprint of several datasets is one.
    """
    two = F.col("is_two_message")
    system = F.col("has_system")
    whole = [(F.grouping("dataset_id") == 1).alias("is_overall")] if overall else []
    groups = features.rollup("dataset_id") if overall else features.groupBy("dataset_id")
    return (
        groups.agg(
            *whole,
            F.count(F.lit(1)).alias("n_examples"),
            F.count_distinct("fingerprint").alias("_distinct"),
            F.sum("blank_responses").alias("blank_responses"),
            F.sum("short_responses").alias("short_responses"),
            F.sum("long_responses").alias("long_responses"),
            F.count_if(two).alias("single_turn"),
            F.count_if(~two).alias("multi_turn"),
            F.count_if(system).alias("with_system"),
            F.count_if(~system).alias("without_system"),
        )
        .withColumn("duplicates", F.col("n_examples") - F.col("_distinct"))
        .select("dataset_id", *(["is_overall"] if overall else []), *_COUNTS)
    )


def quality_score(features: DataFrame, datasets: DataFrame | None = None, overall: bool = False) -> DataFrame:
    """Counts and score per dataset.

    Penalties are subtracted as doubles in check order, then the score is clamped to [0, 1]. With
    ``datasets`` (a ``dataset_id`` table) a dataset without conversations gets a row and scores 0. With
    ``overall`` there is a row for all conversations together, marked ``is_overall``.
    """
    if overall and datasets is not None:
        raise ValueError("a row for all datasets needs no list of datasets")
    counts = quality_counts(features, overall)
    if datasets is not None:
        counts = datasets.select("dataset_id").join(counts, "dataset_id", "left").fillna(0, list(_COUNTS))
    n = F.col("n_examples")
    # Penalties.
    ratio = F.coalesce(T.safe_ratio(F.col("duplicates"), n), F.lit(0.0))
    duplicates = F.least(ratio * 0.4, F.lit(0.3))
    size = F.when(n < 50, 0.5).when(n < 100, 0.2).when(n < 500, 0.1).otherwise(0.0)
    blank = F.when(F.col("blank_responses") > 0, 0.2).otherwise(0.0)
    mixed_system = F.when(
        (F.col("with_system") > 0) & (F.col("without_system") > 0), 0.1
    ).otherwise(0.0)
    score = F.lit(1.0) - duplicates - size - blank - mixed_system
    return counts.withColumn(
        "quality_score",
        F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))),
    )


def _issue(code: str, severity: str, condition: Column, count: Column, message: Column) -> Column:
    return F.when(
        condition,
        F.struct(
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            count.cast("bigint").alias("n"),
            message.alias("message"),
        ),
    )


def quality_issues(scored: DataFrame) -> DataFrame:
    """One row per issue, numbered in check order. A clean dataset gets one ``ok`` row."""
    n = F.col("n_examples")
    dup, blank = F.col("duplicates"), F.col("blank_responses")
    short, long = F.col("short_responses"), F.col("long_responses")
    single, multi = F.col("single_turn"), F.col("multi_turn")
    with_system, without = F.col("with_system"), F.col("without_system")
    percent = T.round_half_even(T.safe_ratio(dup, n) * 100.0)
    some = n > 0

    # Issue texts.
    found = F.array(
        _issue("no_data", "error", n == 0, n, F.lit("No data available")),
        _issue("duplicates", "warning", dup > 0, dup,
               F.format_string("⚠️ %d duplicate conversations (%d%%)", dup, percent)),
        _issue("too_few", "error", some & (n < 50), n,
               F.format_string("❌ Too few examples (%d). Need at least 50.", n)),
        _issue("small", "warning", n.between(50, 99), n,
               F.format_string("⚠️ Small dataset (%d). 100+ recommended for better results.", n)),
        _issue("medium", "info", n.between(100, 499), n,
               F.format_string("💡 %d examples. 500+ recommended for best results.", n)),
        _issue("blank_responses", "error", blank > 0, blank,
               F.format_string("❌ %d empty assistant responses", blank)),
        _issue("short_responses", "info", short > 0, short,
               F.format_string("💡 %d short assistant responses (<10 chars) - fine if intentional", short)),
        _issue("long_responses", "info", long > 0, long,
               F.format_string("💡 %d very long responses (>4000 chars) - may need truncation", long)),
        _issue("mixed_format", "info", (single > 0) & (multi > 0), multi,
               F.format_string("💡 Mixed format: %d single-turn, %d multi-turn conversations", single, multi)),
        _issue("mixed_system", "warning", (with_system > 0) & (without > 0), without,
               F.format_string("⚠️ Inconsistent: %d with system prompt, %d without", with_system, without)),
    )
    kept = F.filter(found, lambda issue: issue.isNotNull())
    clean = F.array(_issue("ok", "ok", F.lit(True), n, F.lit("✅ Data looks good!")))
    return scored.select(
        "dataset_id",
        F.posexplode(F.when(F.size(kept) > 0, kept).otherwise(clean)).alias("issue_no", "issue"),
    ).select(
        "dataset_id", (F.col("issue_no") + 1).cast("bigint").alias("issue_no"), "issue.*"
    )
