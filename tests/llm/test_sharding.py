import math
from collections import Counter

import xxhash

from parley.llm.sharding import Tree, assign


def by_hand(key, tree):
    node, children = "", tree.children()
    for _ in range(3):
        draws = []
        for path, weight in children[node]:
            h = xxhash.xxh64_intdigest(path.encode(), seed=xxhash.xxh64_intdigest(key.encode(), seed=42))
            draws.append((-math.log(((h >> 11) + 0.5) / (1 << 53)) / weight, path))
        node = min(draws)[1]
    return int(node.split("/")[-1])


def docs(spark, n=2000):
    rows = [(i, "x" * (i % 7)) for i in range(n)] + [(None, None), (None, "é"), (5, "x" * 5), (5, "again")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' AS shard", "1 AS size")


def test_shards_follow_the_tree_and_slots_have_no_gaps(spark):
    tree = Tree.even(24)
    grown = tree.grown(24)
    rows = assign(docs(spark), tree, grown).collect()
    assert len(rows) == 2004
    for r in rows:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (by_hand(key, tree), by_hand(key, grown))
        assert r.grown_shard in (r.shard, 24)
    for shard in range(24):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and slots
    assert 40 < sum(r.grown_shard == 24 for r in rows) < 140
    assert {r.size for r in rows if r.doc_id is None} == {8, 10}
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) < 2 * min(counts.values())


def test_movement_stays_in_the_subtree_that_changed(spark):
    tree = Tree.even(16)
    regions = {r: (w, {k: (v, dict(s)) for k, (v, s) in racks.items()}) for r, (w, racks) in tree.regions.items()}
    regions["region1"][1]["rack0"][1][8] = 3.0
    changed = Tree(regions)
    rows = assign(docs(spark), tree, changed).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert moved and all(r.shard in range(8, 12) and r.grown_shard == 8 for r in moved)


def test_empty(spark):
    assert assign(docs(spark).limit(0), Tree.even(3)).count() == 0
