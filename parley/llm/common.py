"""Helpers shared by the operators: input columns, word hashes, connected components."""

from __future__ import annotations

import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import written_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: others may clash as they like."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of ``width`` words; of a shorter sequence, one hash of the whole."""
    n = len(hashes)
    if n == 0:
        return hashes
    width, total = min(width, n), np.zeros(max(1, n - width + 1), np.uint64)
    # Word hashes are random already: a sum of odd multiples tells their order.
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k]
    return mixed(total + np.uint64(width))


BITS = 1 << 23


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Which residues modulo ``BITS`` the hashes in a column have, as packed bits: one megabyte always.

    A filter by it lets through all wanted rows and some others; a join that follows drops those.
    """
    places = keys.select(F.pmod(column, F.lit(BITS)).cast("int").alias("bit")).distinct()
    wanted = np.zeros(BITS, bool)
    wanted[places.toPandas()["bit"].to_numpy(np.int64)] = True
    return np.packbits(wanted)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """``bits`` unpacked, asked for signed or unsigned 64-bit hashes."""
    return bits[(hashes.view(np.int64) & (BITS - 1))]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links``: the smallest node that links reach.

    Alternating large-star and small-star steps: each node hands its neighbours to the smallest one,
    so the number of rounds grows with the logarithm of a component's diameter. Every round is a
    written table; duplicates are removed with partial aggregation before the shuffle.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written_once(edges, "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: every larger neighbour is linked to the smallest one.
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        )
        large = written_once(large.distinct(), "edges")
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        small = written_once(small.distinct(), "edges")
        # Done when every edge hangs on a node that is nobody's child.
        if small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and (
            small.groupBy("u").count().where("count > 1").isEmpty()
        ):
            found = small.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return found.union(roots)
        edges = small


def give_back() -> None:
    """What this process has freed goes back to the system, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def per_process(key: tuple, make):
    """``make()``, shared by the tasks that a worker process runs one after the other.

    A process keeps one such thing: the next operator's takes the place of this one's, so the memory of
    a pipeline is that of its largest stage. It lives in ``sys`` because functions that travel by value
    bring new module globals with each task.
    """
    kept = sys.__dict__.setdefault("_parley_kept", {})
    if key not in kept:
        kept.clear()
        # First what the former operator leaves, then what making this one's thing took on the way.
        give_back()
        kept[key] = make()
        give_back()
    return kept[key]
