"""Line dedup: lines found in many documents, counted in levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import scratch_path, written_once

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hashes(line: Column) -> Column:
    """128 bits of a line's key; null for a line that is never dropped."""
    key = line_key(line)
    return F.when(key != "", F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))


def buckets_for(keys: int) -> int:
    """16 at least, one for every two million keys, and no more than Spark allows."""
    return min(max(16, -(-keys // 2_000_000)), 100_000)


class LineRuns:
    """Sorted runs ``(h1, h2, n)`` of line hashes and the number of documents with each.

    A run is a table bucketed and sorted by the hash in the shared folder, so that runs are merged and
    joined bucket by bucket without a shuffle of theirs. A batch first drops, by a merge anti-join with
    every run, the keys that a run already holds as common; the rest is written as a run of level 0.
    ``fan_in`` runs of a level become one of the next. So a key is rewritten once per level, and the
    number of runs grows with the logarithm of the number of batches.

    The caller owns the folder; ``drop`` takes the runs out of the session's catalogue.
    """

    def __init__(self, spark: SparkSession, min_docs: int, buckets: int = 16, fan_in: int = 2):
        self.spark, self.min_docs, self.buckets, self.fan_in = spark, min_docs, buckets, fan_in
        self.folder = scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = []

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def write(self, counts: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = counts.select(*KEY, "n").repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY)
        writer.sortBy(*KEY).option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def merged(self, names: list[str]) -> DataFrame:
        """The runs as one, by merging their sorted buckets."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed("n", "m"), KEY, "full_outer")
            return both.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(two, [self.spark.table(n) for n in names])

    def add(self, counts: DataFrame) -> None:
        """One batch: its distinct keys ``(h1, h2, n)``."""
        for name in self.runs():
            common = self.spark.table(name).where(F.col("n") >= self.min_docs)
            counts = counts.join(common, KEY, "left_anti")
        self.write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            names, self.levels[level] = self.levels[level], []
            self.write(self.merged(names), level + 1)
            self.forget(names)
            level += 1

    def forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def common(self) -> DataFrame:
        """The keys of at least ``min_docs`` documents, written."""
        found = self.merged(self.runs()).where(F.col("n") >= self.min_docs).select(*KEY)
        return written_once(found, "common-lines")

    def drop(self) -> None:
        self.forget(self.runs())
        self.levels = []


def drop_common_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, batches: int = 4) -> DataFrame:
    """``row`` (the input row as a struct), ``n_lines``, ``n_dropped``, ``kept`` (the other lines).

    A row is a document; a line counts once in it. A null text is one empty line, empty lines and lines
    of blanks alone stay. Copies of a text share one list of dropped lines, found by the text's hash, so
    neither null nor repeated ids matter, and columns of any name pass through untouched in ``row``. An empty
    table gives no rows.

    Texts are read twice: for 16 bytes per line, which then feed the runs batch by batch, and for the
    result. Counts are partial sums before any shuffle, so a line of a third of all documents is one row
    per task; the joins have unique keys on one side, which lets Spark split a skewed other side.
    """
    spark = docs.sparkSession
    # A 128-bit name for a text: what is dropped from it depends on nothing else.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")) if len(set(docs.columns)) == len(
        docs.columns
    ) else docs.toDF(*unique(docs.columns)).select(F.struct("*").alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    name = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]
    hashes = F.transform(F.split(text, "\n", -1), key_hashes).alias("hashes")
    lines = rows.select(*name, hashes).withColumn("batch", F.pmod("t1", F.lit(batches)))
    lines = written_once(lines, "lines")

    keys = lines.select("batch", F.explode(F.array_distinct("hashes")).alias("key")).where("key is not null")
    counts = keys.groupBy("batch", "key.h1", "key.h2").agg(F.count(F.lit(1)).alias("n"))
    counts = written_once(counts, "line-counts")
    # As many buckets as the keys call for; all runs of a set have the same.
    runs = LineRuns(spark, min_docs, buckets_for(counts.count()))
    try:
        for batch in range(batches):
            runs.add(counts.where(F.col("batch") == batch).select(*KEY, "n"))
        common = runs.common()
    finally:
        runs.drop()

    # Texts are few against rows where copies abound: positions are worked out once per text.
    places = lines.select("t1", "t2", F.posexplode("hashes").alias("pos", "key")).where("key is not null")
    places = places.select("t1", "t2", "pos", "key.h1", "key.h2").join(common, KEY)
    dropped = places.groupBy("t1", "t2").agg(F.collect_set("pos").alias("dropped"))
    dropped = written_once(dropped, "dropped-lines")
    all_lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("dropped"))
    kept = F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n")
    return rows.select("row", *name).join(dropped, ["t1", "t2"], "left").select(
        "row",
        F.size(all_lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), text).otherwise(kept).alias("kept"),
    )


def unique(names: list[str]) -> list[str]:
    """Names that clash get a number behind; the first of each name keeps it."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out
