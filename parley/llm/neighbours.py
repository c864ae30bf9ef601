"""Approximate nearest neighbours by a permutation index: vectors as their order of pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import picked
from parley.session import written_once


def usable(vector: Column) -> Column:
    """Neither null nor zero, every component a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(cells: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1)


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """Equal vectors as one class ``(h1, h2, ids, vec)`` with its ``k + 1`` smallest ids.

    No answer can hold more ids of one class than these, and ranks are cut before the shuffle, so a
    vector that a third of all rows repeat is as cheap as any other.
    """
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    least = rows.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1)
    return least.groupBy("h1", "h2").agg(
        F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("vec").alias("vec")
    )


def permutations(classes: DataFrame, pivots: np.ndarray, kind: type, lists: int) -> DataFrame:
    """Add ``data`` (the vector) and ``near`` (the first pivots of its permutation)."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                vectors = np.array(part["vec"].tolist(), kind)
                order = np.argsort(-(vectors.astype(float) @ shared.value.T), axis=1, kind="stable")
                yield pd.DataFrame(
                    {
                        "cid": part["cid"].array,
                        "data": [v.tobytes() for v in vectors],
                        "near": list(order[:, :lists].astype(np.int32)),
                    }
                )

    return classes.select("cid", "vec").mapInPandas(run, "cid string, data binary, near array<int>")


def searched(queries: pd.DataFrame, data: pd.DataFrame, kind: type, k: int, at_once: int = 1_000_000) -> pd.DataFrame:
    """One list, or a block of it: each query against all vectors posted in it, ``at_once`` pairs at a time.

    The ``k + 1`` best of the block are kept, with all that tie. A pair that meets in several lists is
    among the best of each of them or not wanted at all, so it is returned by the first of them alone.
    """
    pivot = int(data["pivot"].iloc[0])
    vectors, asking = matrix(data["data"], kind).astype(float), matrix(queries["data"], kind).astype(float)
    posted, probed = np.array(data["near"].tolist()), np.array(queries["near"].tolist())
    lengths, asked = np.linalg.norm(vectors, axis=1).max(), np.linalg.norm(asking, axis=1)
    # Products of matrices round otherwise than sums of a pair: so far may two ways of adding up differ.
    slack = 4 * vectors.shape[1] * np.finfo(float).eps * lengths * asked
    ids, cids, out = data["cid"].to_numpy(), queries["cid"].to_numpy(), []
    step = max(1, at_once // len(data))
    for at in range(0, len(asking), step):
        rough = asking[at : at + step] @ vectors.T
        if len(data) > k + 1:
            last = np.partition(rough, len(data) - k - 1, axis=1)[:, len(data) - k - 1]
        else:
            last = np.full(len(rough), -np.inf)
        for q, (row, least) in enumerate(zip(rough, last), at):
            best = np.flatnonzero(~(row < least - 2 * slack[q]))
            scores = (vectors[best] * asking[q]).sum(axis=1)
            if len(best) > k + 1:
                good = ~(scores < np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1])
                best, scores = best[good], scores[good]
            before = probed[q][probed[q] < pivot]
            first = ~np.isin(posted[best], before).any(axis=1)
            out.append(pd.DataFrame({"q": cids[q], "cid": ids[best[first]], "score": scores[first]}))
    return pd.concat(out)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int | None = None,
    posted: int = 12,
    probed: int = 20,
    block: int = 20_000,
    query_block: int = 2_000,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows by inner product found for each query.

    ``is_query`` is a condition on ``vec_id``. Pivots are a sample of the vectors, those with the least
    hashes: as many as ``pivots`` says, or 2.5 times the root of their number, then at most 256. Every vector is indexed: its pivots in order of nearness are its permutation, and it is
    posted in the lists of its first ``posted`` pivots. A query looks into the lists of its first
    ``probed`` pivots and scores all that it finds there exactly, however many these are: neither a dense
    group nor long vectors push a neighbour out. Lists longer than ``block``, and queries of a list beyond ``query_block``,
    are dealt out over several tasks, so a list's length is no limit. With few pivots or long lists
    raise ``pivots`` and lower ``posted``: work per query falls with their quotient. The order of the pivots
    decides where a vector is posted and where a query looks; it does not rank what is found there.

    Rows whose id or vector is null, whose vector is zero or holds a null or a number that is not
    finite, or has another length than most, take no part. Equal vectors are searched once; equal
    scores go by the smaller id; a row is never its own neighbour; repeated rows count once. Fewer
    than ``k`` rows are returned only where a query's lists hold fewer; an empty table gives none.
    """
    spark = vectors.sparkSession
    rows = picked(vectors, vec_id=id_col, vec=vector_col).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    kind = np.float32 if "float" in vectors.schema[vector_col].dataType.simpleString() else np.float64
    if kind is np.float64:
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("vec"), "vec")})
    length = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if length is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("vec") == length["size"])
    classes = written_once(vector_classes(rows, k), "vector-classes")
    classes = classes.withColumn("cid", F.concat_ws(":", "h1", "h2"))
    asked = written_once(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct(), "asked")
    count = classes.count()
    size = pivots or min(256, max(16, math.ceil(2.5 * math.sqrt(count))))
    # These vectors come to the driver: 256 at most, or as many as were asked for.
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(size).select("vec").collect()
    centres = np.array([r["vec"] for r in sample], float)
    index = permutations(classes, centres, kind, max(posted, probed))
    index = written_once(index, "permutations")
    wanted = asked.select(F.concat_ws(":", "h1", "h2").alias("cid")).distinct()
    queries = index.join(wanted, "cid", "left_semi")

    def lists(df: DataFrame, first: int) -> DataFrame:
        return df.select("*", F.explode(F.slice("near", 1, first)).alias("pivot"))

    # One row per pivot: how many blocks its list and its queries take.
    sizes = lists(index.select("near"), posted).groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("db"))
    asks = lists(queries.select("near"), probed).groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("qb"))
    blocks = F.broadcast(written_once(sizes.join(asks, "pivot"), "list-blocks"))

    def spread(own: str, other: str, salt: str) -> list[Column]:
        """This side's rows are dealt out by hash and copied to each block of the other side."""
        return [F.pmod(F.xxhash64("cid", F.lit(salt)), own).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))]

    mine, copies = spread("db", "qb", "d")
    left = lists(index, posted).join(blocks, "pivot").select("pivot", "cid", "data", F.slice("near", 1, posted).alias("near"), mine.alias("d"), copies.alias("q"))
    mine, copies = spread("qb", "db", "q")
    right = lists(queries, probed).join(blocks, "pivot")
    right = right.select("pivot", "cid", "data", F.slice("near", 1, probed).alias("near"), mine.alias("q"), copies.alias("d"))

    # Both sides come from one table: new names of columns tell them apart.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def search(data: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asking):
            return pd.DataFrame({"q": [], "cid": [], "score": []})
        return searched(asking, data, kind, k)

    key = ["pivot", "d", "q"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "q string, cid string, score double")
    ids = classes.select("cid", "ids")
    # The classes by score and smallest id: each holds an id at least, so k + 1 of them are enough.
    found = written_once(found, "found")
    best = found.join(ids, "cid").withColumn(
        "r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0]))
    )
    best = best.where(F.col("r") <= k + 1).select("q", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1)
    answers = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    answers = asked.withColumn("q", F.concat_ws(":", "h1", "h2")).join(answers, "q")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    answers = answers.select("query_id", F.posexplode(others).alias("at", "b"))
    return answers.select(
        F.col("query_id").cast("bigint"),
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("b.vec_id").cast("bigint").alias("vec_id"),
        F.col("b.score").alias("score"),
    )
