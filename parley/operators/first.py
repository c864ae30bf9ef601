"""First rows per group and positions in a group, without passing a group through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import written_once

# Spark prunes ``row_number() <= n`` before the shuffle only up to this n
# (spark.sql.optimizer.windowGroupLimitThreshold).
_PRUNED_BY_SPARK = "spark.sql.optimizer.windowGroupLimitThreshold"
_SALTS = 256


def first_rows(
    df: DataFrame, group: list[str], order: list[Column | str], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of every group, numbered from 1 in ``rank``.

    Up to Spark's limit threshold each task keeps its own first ``n`` rows per group before the
    shuffle. Above it the same is done in two steps over a salt, so a hot group is still split.
    """
    if n < 0:
        raise ValueError("the number of rows must not be negative")
    threshold = int(df.sparkSession.conf.get(_PRUNED_BY_SPARK, "1000"))
    if n > threshold:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(_SALTS)))
        within = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = salted.withColumn(rank, F.row_number().over(within)).where(F.col(rank) <= n)
        df = df.drop("_salt", rank)
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def rows_at_quarters(df: DataFrame, group: str, key: str) -> DataFrame:
    """Rows at 0-based positions ``0, n//4, n//2, 3n//4, n-1`` of each group ordered by a BIGINT key.

    The keys are written in ranges of (group, key) that Spark cuts by a sample of them, so a range holds
    about as many rows as any other, however far some keys lie apart. A running sum over the ranges of
    a group finds the range that holds each position, and only those ranges are sorted. Small groups
    repeat a row for several positions. Keys are unique within a group.
    """
    keys = df.select(group, key).repartitionByRange(group, key).withColumn("_bucket", F.spark_partition_id())
    bucketed = written_once(keys, "keys")
    counts = bucketed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    spans = counts.groupBy(group).agg(F.sum("_rows").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))

    n = F.col("_n")
    quarter = lambda i: F.call_function("div", n * i, F.lit(4))
    wanted = spans.select(
        group,
        F.posexplode(F.array(F.lit(0).cast("bigint"), quarter(1), quarter(2), quarter(3), n - 1)).alias(
            "sample_no", "position"
        ),
    )
    targets = (
        wanted.join(ranges, group)
        .where((F.col("position") >= F.col("_before")) & (F.col("position") < F.col("_before") + F.col("_rows")))
        .select(group, "_bucket", "sample_no", "position", "_before")
    )
    in_range = Window.partitionBy(group, "_bucket").orderBy(key)
    ranked = bucketed.join(
        targets.select(group, "_bucket").distinct(), [group, "_bucket"], "left_semi"
    ).withColumn("_rank", F.row_number().over(in_range))
    return (
        targets.join(ranked, [group, "_bucket"])
        .where(F.col("position") == F.col("_before") + F.col("_rank") - 1)
        .select(group, (F.col("sample_no") + 1).cast("bigint").alias("sample_no"), "position", key)
    )
