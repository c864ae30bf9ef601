"""Shards by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import picked
from parley.session import written_once


@dataclass(frozen=True)
class Tree:
    """Regions of racks of ``(shard, weight)``: ``{region: (weight, {rack: (weight, {shard: weight})})}``.

    Every node has a weight of its own, so that a change below a node need not move rows between that
    node and its neighbours.
    """

    regions: dict[str, tuple[float, dict[str, tuple[float, dict[int, float]]]]]

    @staticmethod
    def even(n_shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
        """Equal shards in full regions of ``racks`` x ``per_rack``; a node weighs what it holds."""
        regions: dict = {}
        for shard in range(n_shards):
            region, rack = shard // (racks * per_rack), shard // per_rack % racks
            regions.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
        weigh = {r: {k: (sum(s.values()), s) for k, s in racks_.items()} for r, racks_ in regions.items()}
        return Tree({r: (sum(w for w, _ in racks_.values()), racks_) for r, racks_ in weigh.items()})

    def grown(self, shard: int, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own: no weight of another subtree changes.

        Rows then move into the new shard alone. To fill up a region instead, build a tree with its new
        weights: movement stays inside the subtrees whose weights differ.
        """
        return Tree({**self.regions, f"grown{shard}": (weight, {"rack0": (weight, {shard: weight})})})


    def children(self) -> dict[str, list[tuple[str, float]]]:
        """The children of every inner node, by path; a shard's path ends in its number."""
        found = {"": [(r, w) for r, (w, _) in self.regions.items()]}
        for r, (_, racks) in self.regions.items():
            found[r] = [(f"{r}/{k}", w) for k, (w, _) in racks.items()]
            for k, (_, shards) in racks.items():
                found[f"{r}/{k}"] = [(f"{r}/{k}/{s}", w) for s, w in shards.items()]
        return {node: [(path, w) for path, w in below if w > 0] for node, below in found.items()}


def draw(key: Column, path: Column, weight: Column) -> Column:
    """A node's draw for a key: exponential with the node's weight as rate; the smallest draw wins."""
    # 53 bits of the hash as a number in (0, 1).
    uniform = (F.shiftrightunsigned(F.xxhash64(key, path), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(uniform) / weight


def descend(key: Column, tree: Tree) -> Column:
    """The shard of ``key``: the winning region, the winning rack in it, the winning shard in that.

    Only the children of the nodes on the way are drawn for.
    """
    nodes = F.create_map(
        *[
            part
            for node, below in tree.children().items()
            for part in (
                F.lit(node),
                F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight")) for p, w in below]),
            )
        ]
    )
    node = F.lit("")
    for _ in ("region", "rack", "shard"):
        draws = F.transform(
            F.element_at(nodes, node), lambda c: F.struct(draw(key, c["path"], c["weight"]).alias("draw"), c["path"])
        )
        node = F.array_min(draws)["path"]
    return F.element_at(F.split(node, "/"), -1).cast("int")


def assign(
    docs: DataFrame,
    tree: Tree,
    grown: Tree | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges: int = 64,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row; the law is ``key``.

    The shard follows from the id and the tree alone, so copies of a row share a shard; a null id is a
    key of its own. ``size`` is the text's UTF-8 bytes (null: none) plus 8. Slots number a shard's rows
    without gaps: rows are ordered inside ``ranges`` hash ranges of the shard, each range starts where
    the counts of the ranges before it end. So no task orders a whole shard; raise ``ranges`` with the
    rows of a shard. Only ids, sizes and checksums are shuffled, never texts. Equal texts of different
    ids are different keys and may lie in different shards. Texts of any length count in full, repeated rows
    have slots of their own, an empty table gives no rows.
    """
    rows = picked(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        descend(key, tree).cast("int").alias("shard"),
        (descend(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    # Repeated ids differ in their texts at most; the checksum keeps them from filling one range.
    rows = written_once(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(ranges)).cast("int")), "shards")
    counts = rows.groupBy("shard", "part").count()
    # At most shards x ranges rows.
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("number", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("number")).cast("bigint").alias("slot"),
        "grown_shard",
    )
