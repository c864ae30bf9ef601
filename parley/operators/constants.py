"""Small constant tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def constant_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A literal table, hinted for broadcast: its size is fixed by the program text."""
    literals = F.array(
        *[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row, strict=True)]) for row in rows]
    )
    return F.broadcast(spark.range(0, 1, 1, 1).select(F.inline(literals)))
